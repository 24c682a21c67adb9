"""Mixing sources to target weights by systematic sampling (operator 8).

All documents of a source have the same expected number of copies, target / source size. Laid end to end in
the source's order they cover an interval; one random offset shifts it, and a document is emitted once for
each integer boundary inside its part. So each has the floor or the ceiling of its expectation. The order
goes by size: neighbours are alike, which keeps the words taken near the target.

The prefix sum needs each document's rank within its source. A source may hold most rows, so the rank comes
from three counts: rows in smaller size classes, rows in smaller slots of the class, rows before it in the
slot. Only slots, of bounded size, are sorted in one task.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewave.llm.common import WORD
from linewave.storage import written

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Source -> words to take: ``share`` of all sizes by repeating ``weights``, none above ``most`` times its size.

    Sources go by code point, null last. What a full source leaves goes to the others by their weights,
    again until none is above its bound.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, opened = {}, share * sum(sizes.values()), list(names)
    while opened:
        total = sum(weight[s] for s in opened)
        full = [s for s in opened if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in opened}
        for s in full:
            out[s] = float(most * sizes[s])
        left = max(0.0, left - sum(out[s] for s in full))
        opened = [s for s in opened if s not in out]
    return out


def mix_counts(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    slot_rows: int = 50_000,
    most_sources: int = 1_000_000,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of every row of ``df``.

    Null texts have size 0; a null source is a source of its own; rows that repeat an id are rows like any
    other; a null id is allowed. Extra columns are left out. An empty table gives an empty result. The
    offset of a source depends on ``seed`` and its name alone, so reruns agree. Rows are ranked within slots by a hash of
    the id, so rows of a source and about a size that repeat one id, or have none, share a slot. Per-source sums, at most
    ``most_sources`` of them, are worked out on the driver; more raise an error.
    """
    spark = df.sparkSession
    tag = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"))
    rows = written(
        df.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("name"),
            word_count(F.col(text)).alias("size"),
            F.coalesce(F.octet_length(F.col(text)), F.lit(-1)).alias("n_bytes"),
            tag.alias("tag"),
        ),
        "sizes",
    )
    sums = rows.groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    aim = targets({None if r["name"] == "n" else r["name"][1:]: r["size"] for r in sums}, weights, share, most)
    of = lambda name: aim[None if name == "n" else name[1:]]
    table = spark.createDataFrame(
        [(r["name"], r["size"], of(r["name"]), of(r["name"]) / r["size"] if r["size"] else 0.0) for r in sums],
        "name string, source_size long, target double, expected double",
    )

    # Slots follow the tag, so that class, slot, tag and size give one order within a source. They grow with the root of
    # the rows, as do the rows of one, until ``slot_rows`` bounds the latter.
    n_rows = sum(r.n for r in sums)
    slots = max(1, ceil(sqrt(n_rows) / 8), -(-n_rows // slot_rows))
    head = F.conv(F.substring("tag", 1, 8), 16, 10).cast("long")
    placed = rows.withColumn("class", F.floor(8 * F.log2(F.col("size") + 1)).cast("int")).withColumn("slot", F.floor(head * F.lit(slots) / F.lit(1 << 32)).cast("long"))
    in_slot = placed.groupBy("name", "class", "slot").agg(F.count("*").alias("n"))
    in_class = in_slot.groupBy("name", "class").agg(F.sum("n").alias("n"))
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = in_slot.withColumn("earlier", earlier("name", "class", "slot")).drop("n")
    before = before.join(in_class.withColumn("smaller", earlier("name", "class")).drop("n"), ["name", "class"]).join(table, "name")

    order = Window.partitionBy("name", "class", "slot").orderBy("tag", "size", "n_bytes")
    ranked = placed.withColumn("own", F.row_number().over(order) - 1).join(before, ["name", "class", "slot"])
    # The offset: 52 bits of a hash of seed and source, as a fraction.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("name")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    rank = F.col("smaller") + F.col("earlier") + F.col("own")
    copies = F.floor((rank + 1) * F.col("expected") + offset) - F.floor(rank * F.col("expected") + offset)
    return ranked.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "n_bytes")


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (0, 1 or 2 times at the default bound).

    Rows alike in id, source and length share their copies evenly, in the order of their contents.
    """
    alike = ["doc_id", "source", "n_bytes"]
    counts = mix_counts(df, doc_id, text, source, **how).groupBy(*alike).agg(F.count("*").alias("_lw_n"), F.sum("copies").alias("_lw_copies"))
    counts = written(counts.where("_lw_copies > 0").select(*(F.col(c).alias(f"_lw_{c}") for c in alike), "_lw_n", "_lw_copies"), "copies")
    bytes_of = F.coalesce(F.octet_length(df[text]), F.lit(-1))
    joined = df.join(counts, df[doc_id].cast("long").eqNullSafe(F.col("_lw_doc_id")) & df[source].eqNullSafe(F.col("_lw_source")) & (bytes_of == F.col("_lw_n_bytes")))
    one = joined.where("_lw_n = 1").withColumn("_lw_own", F.col("_lw_copies").cast("int"))
    parts = [one]
    if counts.where("_lw_n > 1").take(1):
        many = joined.where("_lw_n > 1").withColumn("_lw_at", F.row_number().over(Window.partitionBy("_lw_doc_id", "_lw_source", "_lw_n_bytes").orderBy(F.xxhash64(*(df[c] for c in df.columns)))))
        each = F.floor(F.col("_lw_copies") / F.col("_lw_n"))
        parts.append(many.withColumn("_lw_own", (each + (F.col("_lw_at") <= F.col("_lw_copies") - each * F.col("_lw_n")).cast("long")).cast("int")).drop("_lw_at"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where("_lw_own > 0").withColumn("_lw_copy", F.explode(F.sequence(F.lit(1), F.col("_lw_own")))).select(*df.columns)
