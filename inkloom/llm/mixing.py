"""Problem 7: mixing sources to target weights, by hash-threshold histograms.

Every text gets a size in tokens of a public tokenizer and a fixed 64-bit hash. Token sums by (source, leading hash
bits) find the bucket in which a source's budget runs out; only that bucket is counted again, by its next bits, until it
holds a single hash value. A text is then taken once more if its hash lies under its source's threshold: a filter, with no sort and no
shuffle of the texts. Thresholds are nested: a larger budget keeps all that a smaller one took.

Only (source, bucket) sums leave the executors: at most sources x 2**BITS rows, pre-aggregated in each task, so a source
with a third of all rows costs no task more than another.
"""

from __future__ import annotations

import base64
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.llm.common import parts, table

TOKENIZER = os.environ.get("INKLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BITS = 12  # hash bits that one round of the histogram tells apart

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once in each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def canonical(source: Column) -> Column:
    """Source names apart from letter case, outer spaces, and `-`, `_` or blanks between words."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_-]+", "_")


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where one machine runs everything, as in tests, it may be unset; then it is a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "inkloom")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: a cut of the lineage that outlives executors. ``release`` deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what ``durable`` has written in this process; results that are still to be read must have been written before. Returns how many tables there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, hash): canonical source, tokens of the whole text, and a hash that fixes the order in which texts are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = []
            for a, b in parts(texts):
                n += [len(enc.encode_ordinary(t)) if t else 0 for t in texts[a:b]]
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    docs = documents.where(F.col("source").isNotNull()).select("doc_id", canonical(F.col("source")).alias("source"), "text")
    return docs.mapInArrow(run, "doc_id bigint, source string, tokens bigint").select("*", F.xxhash64("doc_id", F.lit("mix")).alias("hash"))


def thresholds(sized: DataFrame, partial: dict[str, int]) -> dict[str, int]:
    """source -> the hash under which texts hold at most that source's partial budget; hashes are taken as unsigned 64 bits."""
    known: dict[str, tuple[int, int, int]] = {s: (0, 0, b) for s, b in partial.items() if b > 0}  # leading bits, how many, budget left
    done = {s: 0 for s, b in partial.items() if b <= 0}
    depth = 0
    while known and depth < 64:
        bits = min(BITS, 64 - depth)
        prefix = F.lit(None).cast("bigint")
        for s, (p, _, _) in known.items():
            prefix = F.when(F.col("source") == s, F.lit(p)).otherwise(prefix)
        inside = F.col("source").isin(list(known)) if depth == 0 else F.shiftrightunsigned("hash", 64 - depth) == prefix
        bucket = F.shiftrightunsigned("hash", 64 - depth - bits).bitwiseAND((1 << bits) - 1).alias("bucket")
        rows = sized.where(inside).groupBy("source", bucket).agg(F.sum("tokens").alias("tokens")).collect()  # at most sources x 2**BITS
        sums: dict[str, dict[int, int]] = {}
        for r in rows:
            sums.setdefault(r["source"], {})[r["bucket"]] = r["tokens"]
        after = {}
        for s, (p, _, left) in known.items():
            cut = 1 << bits
            for b in sorted(sums.get(s, {})):
                if sums[s][b] > left:
                    cut = b
                    break
                left -= sums[s][b]
            if cut == 1 << bits or depth + bits == 64:
                done[s] = ((p << bits) + cut) << (64 - depth - bits)
            else:
                after[s] = ((p << bits) + cut, 0, left)
        known, depth = after, depth + bits
    return done


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """For each target source: tokens there are, wanted, whole rounds through its texts, the hash threshold of one more, and whether it falls short."""
    want: dict[str, tuple[float, int]] = {}
    names: dict[str, str] = {}
    rows = targets.where(F.col("source_name").isNotNull()).select("source_name", canonical(F.col("source_name")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m")).distinct()
    for r in sorted(rows.collect()):  # one row per source of a mix, written by hand
        want.setdefault(r["source"], (r["w"], r["m"]))
        names.setdefault(r["source"], r["source_name"])
    mine = F.when(F.col("source").isin(list(want)), F.col("source"))  # null: sources without a target, which count only in the total
    have = {r[0]: r[1] for r in sized.where("source <> ''").groupBy(mine.alias("source")).agg(F.sum("tokens")).collect()} if want else {}
    total = sum(have.values())
    out, partial = [], {}
    for s, (w, m) in want.items():
        tokens, budget = have.get(s, 0), w * total
        short = tokens * m < budget
        rounds = m if short or not tokens else min(m, int(budget // tokens))
        partial[s] = 0 if rounds >= m else int(budget - rounds * tokens)
        out.append({"source_name": names[s], "source": s, "target_weight": w, "max_repeats": m, "tokens": tokens, "wanted": budget, "rounds": rounds, "short": short, "total": total})
    cut = thresholds(sized, partial)
    return [x | {"below": cut[x["source"]]} for x in out]


def mix(sized: DataFrame, plans: list[dict]) -> DataFrame:
    """(doc_id, source, tokens, copies): the texts of the mix and how often each is used; a narrow filter over the sized texts."""
    copies = F.lit(0)
    low = -(1 << 63)
    for x in plans:
        # unsigned order: with the sign bit turned, hashes compare as bigint
        extra = F.lit(0) if x["below"] == 0 else F.lit(1) if x["below"] >> 64 else (F.col("hash").bitwiseXOR(F.lit(low)) < F.lit(x["below"] + low)).cast("int")
        copies = F.when(F.col("source") == x["source"], F.lit(x["rounds"]) + extra).otherwise(copies)
    return sized.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def report(spark: SparkSession, sized: DataFrame, plans: list[dict]) -> DataFrame:
    """One row per target: tokens there are, tokens in the mix, their share of the size that the mix was to have and of the mix as it is, and whether the target can't be reached."""
    got = mix(sized, plans).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    total = plans[0]["total"] if plans else 0
    base = spark.createDataFrame([(x["source_name"], x["source"], float(x["target_weight"]), int(x["max_repeats"]), int(x["tokens"]), bool(x["short"])) for x in plans], "source_name string, source string, target_weight double, max_repeats int, tokens bigint, short boolean")
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    whole = F.greatest(F.sum(mixed).over(Window.partitionBy(F.lit(0))), F.lit(1))  # over one row a target
    return base.join(got, "source", "left").select("source_name", "target_weight", "max_repeats", "tokens", mixed.alias("mixed_tokens"), F.round(mixed / F.lit(max(total, 1)), 9).alias("share"), F.round(mixed / whole, 9).alias("share_of_mix"), "short")


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of a corpus. The mix is as large as all documents of a known source together.

    Null sources and sources without a target are left out; null or empty texts count 0 tokens; null weights count 0, null max_repeats 1; of targets whose names
    differ only in spelling the first counts; without documents every source with a positive weight has share 0 and none is short.
    A document row that occurs twice is two texts of equal hash: both are taken or none.
    """
    sized = durable(sizes(documents, tokenizer), "mix-sizes")
    plans = plan(sized, targets)
    return mix(sized, plans), report(documents.sparkSession, sized, plans)


def p7_found(spark, sf_dir: str) -> DataFrame:
    _, shares = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return shares.where("short").select("source_name").distinct()


def p7_shares(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]
