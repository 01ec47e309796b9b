"""Document fingerprints (operator 9): DataFrame functions only.

Canonical exact digest: a text is brought to Unicode form NFKC, its case and white space are
folded, and two independently seeded 64-bit xxHashes of the result make a 128-bit bucket.
Buckets are counted by hash first; bytes are compared inside those of two or more, edited texts
included: a bucket's least and greatest canonical text are equal exactly when all its texts are,
and least and greatest need no group to be gathered, so a text with any number of copies costs its
bucket two texts a task. Only buckets that fail the comparison (never seen at 128 bits, but
possible) have their fingerprints extended by the text's SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_LEAST = -(2**63)
#: Size of the filter that is sent to all tasks and tells which texts may be in a bucket of several: 2**24 bits in rows of 64, about 4 MB.
FILTER_BITS = 2**24


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, runs of white space to one space, trimmed."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    # most texts are ASCII, which normalisation leaves as it is and lower() folds in full
    plain = ~text.rlike(r"[^\x00-\x7F]")
    folded = F.when(plain, F.lower(text)).otherwise(nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    """Two 64-bit xxHashes of one text under different seeds."""
    return F.xxhash64(F.lit("first"), canon), F.xxhash64(F.lit("second"), canon)


def hexed(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def collided(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """hi, lo of the buckets that hold different canonical texts. rows: text and edited; prints: their hashes.

    Texts outside buckets of several are left behind by a filter of FILTER_BITS bits; the few that it lets pass do no harm.
    """
    every = prints.select(F.explode(F.array(F.struct(F.col("thi").alias("hi"), F.col("tlo").alias("lo")), F.struct(F.col("ehi").alias("hi"), F.col("elo").alias("lo")))).alias("b")).select("b.*")
    place = F.pmod(F.col("hi"), F.lit(FILTER_BITS))
    line, bit = F.floor(place / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(hi, {FILTER_BITS}) % 64 as int))")
    several = every.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    lines = several.groupBy(line.alias("line")).agg(F.bit_or(bit).alias("bits"))
    texts = rows.select(F.explode(F.array("text", "edited")).alias("raw")).select(canonical(F.col("raw")).alias("canon"))
    hi, lo = wide_hash(F.col("canon"))
    texts = texts.select(hi.alias("hi"), lo.alias("lo"), "canon").withColumn("line", line).join(F.broadcast(lines), "line").where(F.col("bits").bitwiseAND(bit) != 0)
    bucket = texts.groupBy("hi", "lo").agg(F.min("canon").alias("least"), F.max("canon").alias("greatest"))
    return bucket.where("least <> greatest").select("hi", "lo")


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text and next, the text of the document after it by doc_id (after the last: the first).

    Documents are dealt by ranges of doc_id of about equal size, and a copy of each range's first
    document goes to the end of the range before, so no order over the whole table is made in
    one place. Null ids come first; equal ids are in order of a hash of their texts, and where very many
    documents share an id, or have none, ranges are cut within it by that hash.
    """
    spark = docs.sparkSession
    rows = common.take(docs, doc_id="long", text="string").select("doc_id", common.trimmed(F.col("text")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("h", F.xxhash64("text"))
    n = 4 * common.partitions(spark)
    # the driver holds a few numbers for each range, and there are as many ranges as tasks
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0]
    if cuts is None:
        return rows.select("doc_id", "text", F.lit("").alias("next"))
    bounds = sorted(set(cuts))
    within = [0, *[cuts.count(b) for b in bounds]]  # ranges that a bound's own documents fill
    within = [m if m > 1 else 0 for m in within]
    offsets = [0]
    for m in within[:-1]:
        offsets.append(offsets[-1] + m + 1)
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    at = lambda xs, i: F.element_at(listed(xs), (i + 1).cast("int"))
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("k")))
    rows = rows.withColumn("coarse", below(listed(bounds[::step])))
    rows = rows.withColumn("i", F.when(F.col("coarse") == 0, 0).otherwise((F.col("coarse") - 1) * step + below(F.slice(listed(bounds), (F.greatest("coarse", F.lit(1)) - 1) * step + 1, F.lit(step)))))
    rows = rows.withColumn("m", at(within, F.col("i")))
    share = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("m")), F.col("m") - 1)
    inner = F.when(F.col("m") == 0, 0).when(F.col("k") == at([_LEAST, *bounds], F.col("i")), share).otherwise(F.col("m"))
    rows = rows.withColumn("range", at(offsets, F.col("i")) + inner)
    first = {r["range"]: tuple(r["f"]) for r in rows.groupBy("range").agg(F.min(F.struct("k", "h")).alias("f")).collect()}
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    ranges = range(max(order) + 1)
    of = lambda values: at([values.get(r, 0) for r in ranges], F.col("range"))
    places = F.array(F.struct(F.col("range").cast("long").alias("range"), F.lit(0).alias("extra")))
    extra = F.array(F.struct(of(before).alias("range"), F.lit(1).alias("extra")))
    is_first = (F.col("k") == of({r: f[0] for r, f in first.items()})) & (F.col("h") == of({r: f[1] for r, f in first.items()}))
    rows = rows.withColumn("place", F.explode(F.when(is_first, F.concat(places, extra)).otherwise(places)))
    order_by = Window.partitionBy("range").orderBy("extra", "k", "h")
    rows = rows.select("doc_id", "text", "k", "h", "place.range", "place.extra")
    return rows.withColumn("next", F.lead("text").over(order_by)).where("extra = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of
    the next document's. Likeness is that of fingerprints, which are exact: 1.0 where they are equal, as
    canonical texts then are, else 0.0. A null text is empty, and so is its canonical text: all empty texts share a
    fingerprint. A table of one document follows itself. Repeated rows have a row each. An empty table gives
    no rows. Columns other than doc_id and text are not read.
    """
    scratch = common.Scratch(docs.sparkSession, "fingerprints")
    rows = followed(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 2)))"), F.expr("substring(next, 1, int(floor(n_chars / 2)))")))
    texts = {"t": "text", "e": "edited", "n": "next"}
    hashed = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(c) for c in texts.values()])
    for p, c in texts.items():
        hi, lo = wide_hash(F.col(c))
        hashed = hashed.withColumn(f"{p}hi", hi).withColumn(f"{p}lo", lo)
    numbers = [f"{p}{half}" for p in texts for half in ("hi", "lo")]
    found = scratch.save(hashed.select("doc_id", "n_chars", "edited_sha256", *numbers), "prints")
    clash = scratch.save(collided(rows, found), "collided")
    prints = {p: hexed(F.col(f"{p}hi"), F.col(f"{p}lo")) for p in texts}
    if not clash.isEmpty():
        found = hashed
        for p, c in texts.items():
            own = clash.select(F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo"), F.lit(True).alias(f"{p}clash"))
            found = found.join(own, [f"{p}hi", f"{p}lo"], "left")
            prints[p] = F.when(F.col(f"{p}clash"), F.concat(prints[p], F.lit("-"), F.sha2(F.col(c).cast("binary"), 256))).otherwise(prints[p])
    found = found.select("doc_id", "n_chars", "edited_sha256", *[x.alias(p) for p, x in prints.items()])
    like = lambda p: (F.col("t") == F.col(p)).cast("double")
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("t").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), like("e").alias("near_edited"), like("n").alias("near_next"))
