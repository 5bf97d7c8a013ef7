"""Quality rules by cross-document line frequency.

Each line with a word is normalised (A-Z lower-cased, words joined by single spaces) and hashed to 64 bits. Within a host
(the source column) the distinct documents that hold a line are counted; lines above the limit are boilerplate and are
removed; a document that loses more than DEPLETED percent of its words is rejected, as is one that fails the base rules.
quality() gives the counts and drop_rejected() the kept rows as they were; cleaned() gives the kept rows without such lines.

A document is its id, or its text where the id is null, so rows repeated in full count once and copies under other ids count
each. Counting is an aggregate over (host, line, document), so one very common line is spread over all tasks. Lines above a
limit of SHARE percent of the host's documents number at most (100 / SHARE) times the host's lines a document, whatever the
corpus, so the set of a host is a short array, joined back by host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.llm import textkernel as tk
from genloom.runtime import materialize, scratch, small_or_not, table

#: A line is boilerplate if at least so many percent of the host's documents hold it, and so many documents: a host of a few
#: documents has no share to speak of.
SHARE, LEAST = 5, 5
#: A document is depleted if boilerplate lines hold more than so many percent of its words.
DEPLETED = 70
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "id long, host string, digest long, " + ", ".join(f"{c} long" for c in _COLS) + ", line array<long>, line_words array<int>"


def _per_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _worded_lines(data: np.ndarray, off: np.ndarray):
    """(start, end, row) of the lines that hold a word."""
    start, end, row = tk.runs(data == 10, off)
    held = np.concatenate(([0], np.cumsum(~tk._SPACE[data])))
    ok = held[end] > held[start]
    return start[ok], end[ok], row[ok]


def _line_hashes(data: np.ndarray, word: tk.Words, start: np.ndarray):
    """(hash, words) of the normalised lines that begin at start: a polynomial over the hashes of their lower-cased words."""
    n = len(word.start)
    low = tk.hashes(tk._LOWER[data], word.start, word.end)
    line_of = np.searchsorted(start, word.start, "right") - 1
    per_line = np.bincount(line_of, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(per_line)))[:-1]
    up, down = tk._powers(n + 1)
    total = np.concatenate((np.zeros(1, tk.U), np.cumsum(low * up[:n], dtype=tk.U)))
    return tk.mix((total[first + per_line] - total[first]) * down[first] + per_line.astype(tk.U)) if len(start) else np.zeros(0, tk.U), per_line


def measure(data: np.ndarray, off: np.ndarray):
    """Base counts of each row of a slice, a hash of each text, and (row, hash, words) of its normalised lines."""
    rows = len(off) - 1
    word = tk.Words(data, off, lower=False)
    in_word = ~tk._SPACE[data]
    chars = _per_row(in_word & ((data & 0xC0) != 0x80), off)
    symbols = _per_row(_SYMBOL[data], off)
    start, end, row = _worded_lines(data, off)
    raw = tk.hashes(data, start, end)
    order = np.lexsort((raw, row))
    again = np.zeros(len(row), bool)
    again[1:] = (raw[order][1:] == raw[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup = np.bincount(row[order][again], minlength=rows)
    # three-word windows: a window's hash is keyed by its row, equal neighbours after sorting are repeats
    n = len(word.hash)
    full = np.flatnonzero(word.count[word.row] - word.place >= 3)
    key = tk.mix(word.hash[full] * tk._TAPS[0] + word.hash[full + 1] * tk._TAPS[1] + word.hash[full + 2] * tk._TAPS[2] + tk.mix(word.row[full].astype(tk.U)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(full), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 2, bool)
    for i in range(3):
        cover[full[twice] + i] = True
    repeat = np.bincount(word.row[cover[:n]], minlength=rows)
    line, per_line = _line_hashes(data, word, start)
    digest = tk.hashes(data, off[:-1], off[1:])
    return [word.count, chars, symbols, dup, repeat], digest, (row, line, per_line)


def _measured(batches):
    for b in batches:
        cols, digests, lines, words, sizes = [[] for _ in _COLS], [], [], [], [np.zeros(1, np.int64)]
        for _, data, off in tk.slices(b.column("text")):
            counts, digest, (row, line, per_line) = measure(data, off)
            for c, x in zip(cols, counts):
                c.append(x)
            digests.append(digest)
            lines.append(line)
            words.append(per_line)
            sizes.append(np.bincount(row, minlength=len(off) - 1))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        at = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("host"), pa.array(cat(digests, tk.U).view(np.int64)), *(pa.array(cat(c, np.int64)) for c in cols), pa.ListArray.from_arrays(at, pa.array(cat(lines, tk.U).view(np.int64))), pa.ListArray.from_arrays(at, pa.array(cat(words, np.int32)))],
            ["id", "host", "digest", *_COLS, "line", "line_words"],
        )


def _counted(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """The measures of each row, and (host, common): the hashes of each host's boilerplate lines."""
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(host_col), F.lit("")).alias("host"))
    with scratch(docs.sparkSession) as made:
        base = materialize(tk.map_batches(cols, _measured, _SCHEMA), "quality")
        common = materialize(_common(base), "common-lines")
        made.keep(base, common)
    return base, common


def _common(base: DataFrame) -> DataFrame:
    """(host, common): the hashes of each host's boilerplate lines."""
    doc = [F.col("id"), F.when(F.col("id").isNull(), F.col("digest")).alias("text")]
    # counts in two steps, both with map-side combine: distinct (host, line, document) first
    seen = base.select("host", *doc, F.explode(F.array_distinct("line")).alias("h")).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    total = base.select("host", *doc).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    common = seen.filter(F.col("n") >= LEAST).join(small_or_not(materialize(total, "hosts")), "host").filter(F.col("n") * 100 >= F.col("docs") * SHARE)
    return common.groupBy("host").agg(F.collect_set("h").alias("common"))


def _judged(base: DataFrame, common: DataFrame) -> DataFrame:
    out = base.join(small_or_not(common), "host", "left")
    # the document's lines meet the host's set by hash, once; only those found are looked up line by line
    lost = F.expr("transform(array(array_intersect(line, common)), hot -> aggregate(filter(arrays_zip(line, line_words), x -> array_contains(hot, x.line)), 0L, (a, x) -> a + x.line_words))[0]")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = out.withColumn("n_removed_words", F.coalesce(lost, F.lit(0)).cast("long"))
    kept = ~failed & (F.col("n_removed_words") * 100 <= F.col("n_words") * DEPLETED)
    return out.select(F.col("id").alias("doc_id"), *_COLS, "n_removed_words", failed.alias("base_failed"), kept.alias("kept"))


def _gone(judged: DataFrame) -> DataFrame:
    return materialize(judged.filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct(), "rejected")


def _kept_rows(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    return docs.join(small_or_not(gone), F.col(id_col) == F.col("__gone"), "left_anti")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept), a row each.

    A null or empty text has no words and fails the base rule; a null host is the host ''. Repeated rows get equal
    results and count as one document. An empty table gives no rows. Other columns are not read. Nulls as ids pass through;
    each text among them is a document.
    """
    return _judged(*_counted(docs, id_col, text_col, host_col))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs whose id has no rejected text, with docs' columns; rows of a null id stay."""
    with scratch(docs.sparkSession) as made:
        gone = _gone(quality(docs, id_col, text_col, host_col))
        made.keep(gone)
    return _kept_rows(docs, gone, id_col)


def _without(data: np.ndarray, off: np.ndarray, drop) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a slice without the lines (start, end, row), each with the newline that parts it from the next."""
    start, end, row = drop
    step = np.zeros(len(data) + 2, np.int64)
    last = end == off[row + 1]
    np.add.at(step, start, 1)
    np.add.at(step, np.where(last, end, end + 1), -1)
    keep = np.cumsum(step[: len(data)]) == 0
    for i in np.flatnonzero(last):  # a last line goes with the newline that parts it from the last line kept
        a = off[row[i]]
        left = np.flatnonzero(keep[a : start[i]])
        if len(left):
            keep[a + left[-1]] = False
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _cleaned(text_col: str):
    def part(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts, common, parts = b.column(at), b.column("__common"), []
            hot = common.is_valid().to_numpy(zero_copy_only=False)
            # hashes of each distinct set, by its host
            sets, host = {}, b.column("__host").to_pylist()
            for i in np.flatnonzero(hot):
                if host[i] not in sets:
                    sets[host[i]] = np.array(common[int(i)].as_py(), np.int64).view(tk.U)
            for first, data, off in tk.slices(texts):
                start, end, row = _worded_lines(data, off)
                h, _ = _line_hashes(data, tk.Words(data, off, lower=False), start)
                gone = np.zeros(len(row), bool)
                of = host[first : first + len(off) - 1]
                for r in np.flatnonzero(hot[first : first + len(off) - 1]):
                    lo, hi = np.searchsorted(row, (r, r + 1))
                    gone[lo:hi] = np.isin(h[lo:hi], sets[of[r]])
                if gone.any():
                    data, off = _without(data, off, (start[gone], end[gone], row[gone]))
                parts.append(pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]))
            clean = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
            clean = pc.if_else(texts.is_valid(), clean, pa.scalar(None, pa.large_string())).cast(texts.type)
            cols = [clean if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] not in ("__common", "__host")]
            yield pa.RecordBatch.from_arrays(cols, [n for n in b.schema.names if n not in ("__common", "__host")])

    return part


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of drop_rejected, their texts without the boilerplate lines that n_removed_words counts.

    A text is what its other lines give, joined by newlines; a null text stays null. Other columns stay as they are.
    """
    with scratch(docs.sparkSession) as made:
        base, common = _counted(docs, id_col, text_col, host_col)
        gone = _gone(_judged(base, common))
        made.keep(common, gone)
    rows = _kept_rows(docs, gone, id_col).withColumn("__host", F.coalesce(F.col(host_col), F.lit("")))
    common = small_or_not(common.select(F.col("host").alias("__of"), F.col("common").alias("__common")))
    rows = rows.join(common, F.col("__host") == F.col("__of"), "left").drop("__of")
    return tk.map_batches(rows, _cleaned(text_col), docs.schema)


def op5_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


#: kept as SQL; {docs} is the relation of documents.
SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host,
                      coalesce('i' || doc_id, 't' || coalesce(text, '')) AS doc FROM {docs}),
    w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g), range(0, 3) AS t(k)
            WHERE c > 1 GROUP BY r),
    l AS (SELECT r, host, doc, line, norm, len(norm) AS nw FROM (
            SELECT r, host, doc, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS norm
            FROM (SELECT r, host, doc, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(norm) > 0),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
    hot AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc) AS n FROM l GROUP BY 1, 2)
            JOIN (SELECT host, count(DISTINCT doc) AS docs FROM d GROUP BY 1) USING (host) WHERE n >= 5 AND n * 100 >= docs * 5),
    lost AS (SELECT r, sum(nw) AS n FROM l JOIN hot USING (host, norm) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                 coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
          FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 70 * n_words AS kept FROM m
"""
QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": SQL.replace("{docs}", "documents")}
