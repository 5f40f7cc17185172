"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all rows divided by its actual share. Each
document draws its number of copies from a Poisson distribution with that mean by inverting the
distribution function at a uniform number hashed from the seed and the document's id; documents are
exploded by that number and dealt out in a hashed global order. Where the mean is above HIGH, the number
is the sum of independent draws of equal means of at most HIGH, since exp(-mean) underflows from 746 on.

Targets: a dict of weights by source (sources not named get weight 0; ``None`` names documents without
a source), or a temperature: weight proportional to (number of documents) ** temperature.

Only counts by source are aggregated, so a source with a third of all rows costs a partial sum per task.
The table of rates has one row per source; it is broadcast only if it is measured to be small.

Edge cases: documents without a source are a source of their own; a null id hashes as the text ``null``;
rows with equal ids and texts get equal counts; an empty table gives an empty result; other columns ride
along whatever their names, except that columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.base import BROADCAST_ROWS, Scratch

TEMPERATURE = 0.5
SEED = 17
#: The distribution is inverted up to this many standard deviations (plus 20) above the mean; what lies beyond has a probability under 1e-20.
TAIL = 12
#: The largest mean of one draw: exp(-HIGH) is a normal double (they end near exp(-708)), so the terms of the distribution have full precision.
HIGH = 700


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts (column names, columns, or fixed texts after ``=``) joined by a colon."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) and not p.startswith("=") else F.lit(str(p).lstrip("=")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source_key, rate, draws, steps): mean number of copies of each document of a source, the number of draws it is split into, and the distribution function of one draw at 0, 1, 2, ..."""
    counts = docs.groupBy(F.col("source").alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        weight = F.lit(0.0)
        for k, v in targets.items():
            weight = F.when(F.col("source_key").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
        weighted = counts.withColumn("w", weight)
    total = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    # the totals are one row, which every source's row is given
    rated = weighted.join(F.broadcast(total)).select("source_key", F.coalesce(F.try_divide(F.col("w") * F.col("all_n"), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("draws", F.greatest(F.ceil(F.col("rate") / HIGH), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    most = (F.col("mean") + TAIL * F.sqrt("mean") + 20).cast("int")
    term = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    steps = F.aggregate(
        F.sequence(F.lit(1), most),
        term,
        lambda acc, j: F.struct((acc["p"] * F.col("mean") / j).alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / j).alias("cdf")),
    )["cdf"]
    return rated.select("source_key", "rate", "draws", steps.alias("steps"))


def replicate(docs: DataFrame, targets: dict | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` plus ``copy`` (1, 2, ...) and ``shuffle_key``, globally shuffled by the latter."""
    scratch = Scratch(docs.sparkSession)
    table = scratch.save(rates(docs.select("source"), targets, temperature), "rates")
    small = table.count() <= BROADCAST_ROWS // 50  # rows of some dozens of numbers, of a high rate up to HIGH + TAIL * sqrt(HIGH) + 20
    # the documents' own columns travel in a struct, so that none of their names can meet one of these
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    docs = docs.select(F.struct(*columns).alias("doc"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("of"))
    joined = docs.join(F.broadcast(table) if small else table, F.col("of").eqNullSafe(F.col("source_key")))
    count = lambda u: F.size(F.filter("steps", lambda c: c <= u))
    # the numbers of the further draws come as an array, so that each is hashed once and not for each step
    more = F.transform(F.sequence(F.lit(2), F.col("draws")), lambda j: uniform(f"={seed}", F.concat(F.lit("copies/"), j.cast("string")), "id"))
    further = F.when(F.col("draws") > 1, F.aggregate(more, F.lit(0), lambda acc, u: acc + count(u))).otherwise(0)
    drawn = joined.withColumn("u", uniform(f"={seed}", "=copies", "id")).withColumn("k", count(F.col("u")) + further)
    copies = drawn.where("k > 0").select("doc", "id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", uniform(f"={seed}", "=order", "id", "copy")).select("doc.*", "copy", "shuffle_key")
    return keyed.repartition(F.hash("shuffle_key")).sortWithinPartitions("shuffle_key")


def oracle(temperature: float = TEMPERATURE, seed: int = SEED, docs: str = "documents", columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars") -> str:
    """DuckDB SQL of ``replicate`` with a temperature; the distribution's terms come from log-gamma, not from a recurrence."""
    u = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""
with counts as (select source, count(*)::double as n from {docs} group by source),
rates as (select source, pow(n, {temperature!r}) * sum(n) over () / (sum(pow(n, {temperature!r})) over () * n) as rate from counts),
means as (select source, greatest(ceil(rate / {HIGH}), 1)::int as draws, rate / greatest(ceil(rate / {HIGH}), 1) as mean from rates),
terms as (
  select source, draws, j, case when mean = 0 then (j = 0)::int::double else exp(j * ln(mean) - mean - lgamma(j + 1.0)) end as p
  from (select *, unnest(range(0, (mean + {TAIL} * sqrt(mean) + 20)::int + 1)) as j from means)),
steps as (select source, draws, j, sum(p) over (partition by source order by j) as cdf from terms),
tables as (select source, any_value(draws) as draws, list(cdf order by j) as cdfs from steps group by source),
drawn as (
  select d.*, list_sum(list_transform(range(1, t.draws + 1), lambda i: len(list_filter(t.cdfs, lambda c: c <=
    {u.format(f"concat('{seed}:copies', case when i > 1 then concat('/', i::varchar) else '' end, ':', coalesce(d.doc_id::varchar, 'null'))")}))))::bigint as k
  from {docs} d join tables t on d.source is not distinct from t.source),
copies as (select *, unnest(range(1, k + 1)) as copy from drawn where k > 0)
select {columns}, d.copy::int as copy, {u.format(f"concat('{seed}:order:', coalesce(d.doc_id::varchar, 'null'), ':', d.copy::varchar)")} as shuffle_key from copies d
"""
