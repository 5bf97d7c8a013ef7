"""Language identification of words by a linear-chain conditional random field.

A word (a run of letters, lower-cased) has as features the hashes of its byte n-grams of 1 to 3, of its prefixes and
suffixes of 1 to 3, and of the word itself (lexicon). Features have a weight for each language, and pairs of neighbouring
words a learned transition weight. Forward-backward gives every word the posterior of each language, so code-switched text
gets labels word by word; a document's language is the one with the largest share of its letters.

Training maximises the likelihood of sequences spliced from documents of different languages, so that switches occur in it
and transitions are learned. It takes SAMPLE labelled rows at most, those with the smallest hash of their id, of texts of
LONGEST characters at most; that bounds what comes to the driver. Inference reads every whole text. A long text's chain is
cut into segments whose transfer matrices are multiplied, which is exact and keeps all steps vectorised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.llm import textkernel as tk
from genloom.runtime import table

SAMPLE, LONGEST = 600, 20_000
BITS = 17
SEGMENT = 64
EPOCHS, RATE, L2 = 25, 0.3, 1e-5
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_MASK = tk.U((1 << BITS) - 1)


class Features:
    """Letter words of a slice and the table slots of their features; slot 0 stands for no feature."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        inside = _LETTER[data]
        self.start, self.end, self.row = tk.runs(~inside, off)
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        d = data.astype(np.uint32)
        one = d * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
        ok = inside
        self.grams = []
        hashes, h = [], one
        for k in range(1, 4):
            if k > 1:
                h = np.zeros(n, np.uint32)
                h[: n - k + 1] = (hashes[-1][: n - k + 1] ^ (hashes[-1][: n - k + 1] >> 15)) * np.uint32(0x2C1B3C6D) + one[k - 1 :]
                ok = ok.copy()
                ok[: n - k + 1] &= inside[k - 1 :] & ~first[k - 1 : n]
                ok[n - k + 1 :] = False
            hashes.append(h)
            self.grams.append(np.where(ok, self._slot(h, k), 0))
        size = self.end - self.start
        self.word = []
        for k in range(1, 4):
            long = size >= k
            self.word.append(np.where(long, self._slot(hashes[k - 1][self.start], 8 + k), 0))
            self.word.append(np.where(long, self._slot(hashes[k - 1][np.maximum(self.end - k, 0)], 16 + k), 0))
        self.word.append(self._slot((tk.hashes(data, self.start, self.end) >> tk.U(32)).astype(np.uint32), 32))

    @staticmethod
    def _slot(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h ^ np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) * np.uint32(0x297A2D39)
        return ((h ^ (h >> 15)) & np.uint32((1 << BITS) - 1)).astype(np.int32)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(words, languages): summed weights."""
        out = np.zeros((len(self.start), weights.shape[1]), np.float32)
        if len(self.start):
            for g in self.grams:
                out += np.add.reduceat(weights[g], self.start, axis=0)
            for s in self.word:
                out += weights[s]
        return out

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, slot) of every feature, for training."""
        at = np.searchsorted(self.start, np.arange(len(self.grams[0])), "right") - 1
        words = [at[g > 0] for g in self.grams] + [np.flatnonzero(s) for s in self.word]
        return np.concatenate(words), np.concatenate([g[g > 0] for g in self.grams] + [s[s > 0] for s in self.word])


def _lower(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with a space for what is neither ASCII nor a letter or its mark: dashes, quotation marks, signs."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(low, r"[^\p{L}\p{M}\x00-\x7f]+", " ")


def posteriors(emission: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over chains that start at the indices first; (words, languages).

    Each chain is cut into segments of SEGMENT words. A segment's transfer matrix takes a forward vector across it; chains
    of these matrices give each segment its forward and backward vectors at the ends, then all segments run at once.
    """
    n, k = emission.shape
    if not n:
        return np.zeros((0, k))
    size = np.diff(np.append(first, n))
    segs = -(-size // SEGMENT)
    chain = np.repeat(np.arange(len(first)), segs)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(segs) - segs, segs)
    begin = first[chain] + rank * SEGMENT
    length = np.minimum(SEGMENT, size[chain] - rank * SEGMENT)
    at = np.minimum(begin[:, None] + np.arange(SEGMENT), n - 1)
    on = np.arange(SEGMENT) < length[:, None]
    e = np.exp((emission - emission.max(axis=1, keepdims=True)).astype(np.float64))[at] + 1e-30
    a = np.exp(trans - trans.max())
    m = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(int(length.max())):
        new = (m.reshape(-1, k) @ a).reshape(-1, k, k) * e[:, t, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        m = np.where(on[:, t, None, None], new, m)
    fwd, back = np.full((len(chain), k), 1.0 / k), np.ones((len(chain), k))
    order = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[order], np.arange(int(rank.max()) + 2))
    for r in range(1, len(cuts) - 1):
        i = order[cuts[r] : cuts[r + 1]]
        v = np.einsum("nk,nkl->nl", fwd[i - 1], m[i - 1])
        fwd[i] = v / v.sum(axis=1, keepdims=True)
    for r in range(len(cuts) - 2, 0, -1):
        i = order[cuts[r] : cuts[r + 1]]
        v = np.einsum("nkl,nl->nk", m[i], back[i])
        back[i - 1] = v / v.sum(axis=1, keepdims=True)
    out = np.empty((len(chain), SEGMENT, k))
    v = fwd
    for t in range(int(length.max())):
        v = (v @ a) * e[:, t]
        v = v / v.sum(axis=1, keepdims=True)
        out[:, t] = v
    v = back
    for t in range(int(length.max()) - 1, -1, -1):
        out[:, t] *= np.where(on[:, t, None], v, 1.0)
        new = (e[:, t] * v) @ a.T
        v = np.where(on[:, t, None], new / new.sum(axis=1, keepdims=True), v)
    out = out[on]
    return out / out.sum(axis=1, keepdims=True)


def _pairwise(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, expected transitions) of chains of equal length: emission is (chains, words, languages)."""
    c, n, k = emission.shape
    e, a = np.exp(emission - emission.max(axis=2, keepdims=True)), np.exp(trans - trans.max())
    f, b = np.empty((n, c, k)), np.empty((n, c, k))
    v = np.full((c, k), 1.0 / k)
    for t in range(n):
        v = (v @ a if t else v) * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        f[t] = v
    v = np.ones((c, k))
    for t in range(n - 1, -1, -1):
        b[t] = v
        v = (e[:, t] * v) @ a.T
        v /= v.sum(axis=1, keepdims=True)
    post = f * b
    post /= post.sum(axis=2, keepdims=True)
    both = np.einsum("tck,kl,tcl->tckl", f[:-1], a, e.transpose(1, 0, 2)[1:] * b[1:], optimize=True)
    both /= both.sum(axis=(2, 3), keepdims=True)
    return post.transpose(1, 0, 2), both.sum(axis=(0, 1))


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """A model from labelled texts: the languages, feature weights (2 ** BITS, languages) and transition weights."""
    names = sorted(set(langs))
    k = len(names)
    rng = np.random.default_rng(seed)
    if k < 2:
        return {"langs": names, "weights": np.zeros((1 << BITS, max(k, 1)), np.float32), "trans": np.zeros((max(k, 1),) * 2)}
    gold = np.array([names.index(x) for x in langs])
    words, slots, chunks, base = [], [], [], 0
    for first, data, off in tk.slices(_lower(pa.array(texts, pa.string()))):
        f = Features(data, off)
        w, s = f.slots()
        words.append(w + base)
        slots.append(s)
        label = gold[first + f.row]
        place = np.arange(len(label)) - np.searchsorted(f.row, f.row)
        # pieces of 8 words of one document; pieces are shuffled into chains, so chains switch languages
        ok = np.flatnonzero((place % 8 == 0))
        ok = ok[(ok + 8 <= len(label))]
        ok = ok[f.row[ok] == f.row[np.minimum(ok + 7, len(label) - 1)]]
        chunks.append((ok[:, None] + np.arange(8)) + base)
        words_label = label if not base else np.concatenate((words_label, label))
        base += len(label)
    if not base:  # no text has a letter
        return {"langs": names, "weights": np.zeros((1 << BITS, k), np.float32), "trans": np.zeros((k, k))}
    words, slots = np.concatenate(words), np.concatenate(slots)
    order = np.argsort(words, kind="stable")
    words, slots = words[order], slots[order]
    cut = np.searchsorted(words, np.arange(base))
    chunks = np.concatenate(chunks)
    runs = np.lexsort((rng.random(len(chunks)), words_label[chunks[:, 0]])) if len(chunks) else np.zeros(0, int)
    runs = runs[: len(runs) // 2 * 2].reshape(-1, 2)  # two pieces of a language in a row, then any other two
    runs = runs[rng.permutation(len(runs))]
    per = 4
    chains = chunks[runs[: len(runs) // per * per].reshape(-1)].reshape(-1, per * 2 * 8) if len(runs) >= per else chunks
    y = words_label[chains]
    weights, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    g2w, g2t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    flat = chains.ravel()
    for _ in range(EPOCHS):
        emission = np.add.reduceat(weights[slots], np.minimum(cut, len(slots) - 1), axis=0)
        post, moved = _pairwise(emission[chains], trans)
        err = -post
        err[np.arange(len(y))[:, None], np.arange(y.shape[1]), y] += 1
        by_word = np.stack([np.bincount(flat, err[:, :, j].ravel(), base) for j in range(k)], 1)
        grad = np.stack([np.bincount(slots, by_word[words, j], 1 << BITS) for j in range(k)], 1) - L2 * len(flat) * weights
        g2w += grad**2
        weights += RATE * grad / np.sqrt(g2w)
        grad = seen - moved
        g2t += grad**2
        trans += RATE * grad / np.sqrt(g2t)
    weights[0] = 0
    return {"langs": names, "weights": weights.astype(np.float32), "trans": trans}


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE) -> DataFrame:
    """The labelled rows that training takes: at most so many, by the smallest hash of their id.

    The hashes alone decide, so a task sends at most so many numbers to the driver; texts come for the chosen rows only.
    """
    ok = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= LONGEST)
    able = docs.filter(ok).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    last = able.select("h").orderBy("h").limit(rows).agg(F.max("h").alias("h")).first().h
    return able.filter(F.col("h") <= F.lit(last if last is not None else 0)).distinct().orderBy("h", "text", "lang").limit(rows)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Trains on a bounded sample of the labelled rows."""
    rows = sample(labelled, id_col, text_col, lang_col).collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_switches): a row each.

    lang_pred is a language of the model, or und with score 0 if the text is null, has no letter, or the model knows no
    language; score is the language's share of the text's letters, weighed by posteriors; n_switches counts neighbouring
    words labelled differently. Repeated rows are labelled each; an empty table gives no rows; other columns are not read.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        m = spread.value
        for b in batches:
            pred, score, moves = [], [], []
            for first, data, off in tk.slices(_lower(b.column(1))):
                f, rows = Features(data, off), len(off) - 1
                best, share, turn = np.zeros(rows, int), np.zeros(rows), np.zeros(rows, int)
                if len(f.start) and m["langs"]:
                    starts = np.flatnonzero(np.concatenate(([True], f.row[1:] != f.row[:-1])))
                    p = posteriors(f.emissions(m["weights"]), m["trans"], starts)
                    size = (f.end - f.start).astype(np.float64)
                    total = np.add.reduceat(p * size[:, None], starts, axis=0) / np.add.reduceat(size, starts)[:, None]
                    at = f.row[starts]
                    best[at], share[at] = total.argmax(axis=1), total.max(axis=1)
                    label = p.argmax(axis=1)
                    turn = np.bincount(f.row[1:][(label[1:] != label[:-1]) & (f.row[1:] == f.row[:-1])], minlength=rows)
                plain = np.add.reduceat(np.concatenate((((data >= 97) & (data < 123)), [False])).astype(np.int64), off[:-1]) * (off[1:] > off[:-1])
                for i in range(rows):
                    ok = m["langs"] and (plain[i] > 0 or (off[i + 1] > off[i] and _has_letter(b.column(1)[first + i].as_py())))
                    pred.append(m["langs"][best[i]] if ok else "und")
                    score.append(float(min(1.0, share[i])) if ok else 0.0)
                    moves.append(int(turn[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(moves, pa.int64())], ["doc_id", "lang_pred", "score", "n_switches"])

    return tk.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), part, "doc_id long, lang_pred string, score double, n_switches long")


def label_words(texts: list[str | None], model: dict) -> list[list[str]]:
    """The language of each letter word of each text."""
    out = []
    for _, data, off in tk.slices(_lower(pa.array(texts, pa.string()))):
        f = Features(data, off)
        starts = np.flatnonzero(np.concatenate(([True], f.row[1:] != f.row[:-1]))) if len(f.row) else np.zeros(0, int)
        best = posteriors(f.emissions(model["weights"]), model["trans"], starts).argmax(axis=1)
        cut = np.searchsorted(f.row, np.arange(len(off)))
        out += [[model["langs"][j] for j in best[cut[i] : cut[i + 1]]] for i in range(len(off) - 1)]
    return out


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang").filter(~held))
    out = identify(docs, model)
    return out.withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict = {}
