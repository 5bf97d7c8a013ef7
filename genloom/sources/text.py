"""Readers and writers of the white-space separated text formats. Schemas are explicit; NA is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom import schemas
from genloom.sources.paths import expand, number_in


def _csv(spark: SparkSession, template: str, schema: str, sep: str = " ", header: bool = False) -> DataFrame:
    return spark.read.csv(expand(template), schema=schema, sep=sep, header=header, nullValue=schemas.MISSING, ignoreLeadingWhiteSpace=True)


def with_chromosome(df: DataFrame, template: str) -> DataFrame:
    """df with chr, the number that the template's range has in each row's file."""
    return df.withColumn("chr", number_in(template, F.col("_metadata.file_path"))) if "{" in template else df


def read_ids(spark: SparkSession, template: str, names: list[str] | None = None) -> DataFrame:
    """Lists of ids without a header, one or more white-space separated fields a line; empty lines are skipped."""
    names = names or ["id"]
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(expand(template)).filter(F.trim("value") != "").select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def read_map(spark: SparkSession, template: str) -> DataFrame:
    return with_chromosome(_csv(spark, template, schemas.GENETIC_MAP, header=True), template)


def read_partition(spark: SparkSession, template: str) -> DataFrame:
    """One line a variant: its id, then its group at each resolution; long form (snp_id, res, group_id)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = with_chromosome(spark.read.text(expand(template)), template).withColumn("p", parts).filter(F.expr("try_cast(get(p, 1) AS BIGINT) IS NOT NULL"))
    keep = [c for c in rows.columns if c == "chr"]
    return rows.select(*keep, F.col("p")[0].alias("snp_id"), F.posexplode(F.slice("p", 2, 1000)).alias("res", "g")).select(*keep, "snp_id", "res", F.col("g").cast("bigint").alias("group_id"))


def read_ibd(spark: SparkSession, template: str) -> DataFrame:
    """Segments: seg_id, comma-joined haplotype indices, j_min, j_max, bp_min, bp_max; indices become a sorted set."""
    raw = _csv(spark, template, "seg_id bigint, indices string, j_min bigint, j_max bigint, bp_min bigint, bp_max bigint", header=True)
    return with_chromosome(raw, template).withColumn("indices", F.array_sort(F.array_distinct(F.transform(F.split("indices", ","), lambda x: x.cast("bigint")))))


def read_covariates(spark: SparkSession, template: str, k_max: int) -> DataFrame:
    """(iid, z): an id and numbers a line; at most k_max are kept. A line whose second field is no number is a header."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(expand(template)).select(parts.alias("p")).filter(F.expr("try_cast(get(p, 1) AS DOUBLE) IS NOT NULL"))
    return rows.select(F.col("p")[0].alias("iid"), F.transform(F.slice("p", 2, k_max), lambda x: x.cast("double")).alias("z"))


def read_key(spark: SparkSession, template: str) -> DataFrame:
    """Key files with header Chr Variant Position Group Knockoff, as (CHR, SNP, BP, Group, Knockoff)."""
    return spark.read.csv(expand(template), schema=schemas.KEY, sep=" ", header=True, enforceSchema=True, nullValue=schemas.MISSING)


def read_bim(spark: SparkSession, template: str) -> DataFrame:
    return _csv(spark, template, schemas.BIM, sep="\t")


def read_fam(spark: SparkSession, template: str) -> DataFrame:
    return _csv(spark, template, schemas.FAM)


def numbered(lines: DataFrame) -> DataFrame:
    """(i, value): the lines of a text source with their place from 0, in order of file names and of places in a file.

    Spark deals files to tasks by size, so tasks are no order: a line's place is that of its split among all splits (a
    short list, on the driver) and its own in the split.
    """
    spark = lines.sparkSession
    read = lines.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value").rdd  # planned once: both passes see the same splits

    def count(rows):
        n = {}
        for r in rows:
            n[r.f, r.b] = n.get((r.f, r.b), 0) + 1
        return n.items()

    starts, at = {}, 0
    for split, n in sorted(read.mapPartitions(count).collect()):
        starts[split], at = at, at + n

    def place(rows):
        n = dict(starts)
        for r in rows:
            yield n[r.f, r.b], r.value
            n[r.f, r.b] += 1

    return spark.createDataFrame(read.mapPartitions(place), "i bigint, value string")


def read_haps(spark: SparkSession, haps: str, legend: str, sample: str) -> DataFrame:
    """(snp_idx, snp_id, bp, a1, a2, alleles): a line of 0/1 a variant, joined with the legend by line number.

    Line numbers are those of numbered(); a haplotype file is one file a chromosome, or a folder of its parts.
    """
    del sample  # the sample file names the columns; see read_samples
    number = lambda df: numbered(df).withColumnRenamed("i", "snp_idx")
    rows = number(spark.read.text(haps)).select("snp_idx", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("tinyint")).alias("alleles"))
    leg = number(spark.read.text(legend)).filter("snp_idx > 0").select((F.col("snp_idx") - 1).alias("snp_idx"), F.split(F.trim("value"), r"\s+").alias("p"))
    leg = leg.select("snp_idx", F.col("p")[0].alias("snp_id"), F.col("p")[1].cast("bigint").alias("bp"), F.col("p")[2].alias("a1"), F.col("p")[3].alias("a2"))
    return leg.join(rows, "snp_idx")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(fid, iid, sample_idx) of a sample file with two header lines."""
    rows = numbered(spark.read.text(path)).filter("i > 1")
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select(parts[0].alias("fid"), parts[1].alias("iid"), (F.col("i") - 2).alias("sample_idx"))


def to_haplotypes(variants: DataFrame, chromosome: int) -> DataFrame:
    """Packed haplotypes (chr, hap_id, n, words) of a variant-major table (snp_idx, alleles)."""
    from genloom.operators.haplo import pack

    long = variants.select("snp_idx", F.posexplode("alleles").alias("hap_id", "a"))
    rows = long.groupBy("hap_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("snp_idx", "a"))), lambda x: x["a"].cast("int")).alias("alleles"))
    return rows.select(F.lit(chromosome).alias("chr"), F.col("hap_id").cast("bigint").alias("hap_id"), F.size("alleles").alias("n"), pack("alleles").alias("words"))


def write_keys(df: DataFrame, path: str) -> None:
    """Key files: Chr Variant Position Group Knockoff with a header, from (CHR, SNP, BP, Group, Knockoff)."""
    names = {"CHR": "Chr", "SNP": "Variant", "BP": "Position", "Group": "Group", "Knockoff": "Knockoff"}
    write_table(df.select(*[F.col(a).alias(b) for a, b in names.items()]), path)


def write_table(df: DataFrame, path: str, sep: str = " ", header: bool = True, compression: str = "none") -> None:
    """Columns between separators; each file of the folder has its own header."""
    df.write.mode("overwrite").options(header=header, sep=sep, nullValue=schemas.MISSING, compression=compression).csv(path)


def write_ibd(df: DataFrame, path: str) -> None:
    """Segments with their haplotypes' indices joined by commas."""
    write_table(df.withColumn("indices", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",")).select("seg_id", "indices", "j_min", "j_max", "bp_min", "bp_max"), path)


def write_partition_file(df: DataFrame, path: str) -> None:
    """A line a variant: its id and its group at each resolution, from the long form (snp_id, res, group_id)."""
    groups = F.transform(F.array_sort(F.collect_list(F.struct("res", "group_id"))), lambda x: x["group_id"].cast("string"))
    df.groupBy("snp_id").agg(groups.alias("g")).select(F.concat_ws(" ", "snp_id", F.array_join("g", " ")).alias("value")).write.mode("overwrite").text(path)


def write_dimacs(edges: DataFrame, path: str) -> None:
    """e lines; the head with the numbers of vertices and edges is a file of its own."""
    edges.select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value")).write.mode("overwrite").text(path)
    head = edges.agg(F.concat_ws(" ", F.lit("p edge"), F.greatest(F.max("src"), F.max("dst")), F.count(F.lit(1))).alias("value"))
    head.write.mode("append").text(path)


def write_metis(edges: DataFrame, vertices: int, path: str) -> None:
    """An adjacency file of an undirected graph on vertices 1 to n, each edge given once: line i has the neighbours of i."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), " ").alias("value"))
    spark = edges.sparkSession
    rows = spark.range(1, vertices + 1).withColumnRenamed("id", "src").join(near, "src", "left").select("src", F.coalesce("value", F.lit("")).alias("value"))
    head = edges.agg(F.lit(0).cast("long").alias("src"), F.concat_ws(" ", F.lit(vertices), F.count(F.lit(1))).alias("value"))
    rows.unionByName(head).repartitionByRange("src").sortWithinPartitions("src").select("value").write.mode("overwrite").text(path)


def write_list(df: DataFrame, path: str) -> None:
    """Columns separated by spaces, no header."""
    df.write.mode("overwrite").option("header", False).option("sep", " ").option("nullValue", schemas.MISSING).csv(path)


def write_samples(df: DataFrame, path: str) -> None:
    """ID_1 ID_2 with a header."""
    df.select(F.col("fid").alias("ID_1"), F.col("iid").alias("ID_2")).write.mode("overwrite").option("header", True).option("sep", " ").csv(path)


def write_haps(variants: DataFrame, path: str) -> None:
    """One line of space-joined alleles a variant, in order of snp_idx."""
    variants.repartitionByRange("snp_idx").sortWithinPartitions("snp_idx").select(F.array_join(F.transform("alleles", lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by chromosome and resolution, so later scans prune by path."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def read_dimacs(spark: SparkSession, template: str) -> DataFrame:
    """(src, dst) of the e lines of graph files, counted from 1."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(expand(template)).select(parts.alias("p")).filter("p[0] = 'e'")
    return rows.select(F.col("p")[1].cast("bigint").alias("src"), F.col("p")[2].cast("bigint").alias("dst"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of an unweighted adjacency file, vertices counted from 1; comment lines start with %."""
    lines = numbered(spark.read.text(path).filter(~F.col("value").startswith("%"))).withColumnRenamed("i", "src").filter("src > 0")
    return lines.select("src", F.explode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("d")).select("src", F.col("d").cast("bigint").alias("dst"))


def read_graphviz(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, directed) of the edges of simple graph descriptions: a -> b or a -- b, names as they stand."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r'^\s*"?([\w.]+)"?\s*(-[->])\s*"?([\w.]+)"?', 1).alias("src"), F.regexp_extract("value", r'^\s*"?[\w.]+"?\s*-[->]\s*"?([\w.]+)"?', 1).alias("dst"), F.col("value").contains("->").alias("directed"))
    return lines.filter("src <> '' AND dst <> ''")


def write_graphviz(edges: DataFrame, path: str, directed: bool = True) -> None:
    sign = "->" if directed else "--"
    edges.select(F.concat_ws(f" {sign} ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def read_annotation(spark: SparkSession, path: str, fields: dict[str, int]) -> DataFrame:
    """(chrom, start, end, name) of a tab-separated table, gzipped or not; fields are places from 0."""
    parts = F.split("value", "\t")
    kinds = {"chrom": "string", "start": "bigint", "end": "bigint", "name": "string"}
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(*[F.get(parts, fields[n]).cast(t).alias(n) for n, t in kinds.items()])
