"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key ``-ln(u) / w``, with u a hash of its id in (0, 1) and w its quality
weight. Ascending keys order a source as weighted sampling without replacement would. A
source's budget takes complete epochs of all its documents first; what remains is filled in key
order by prefix sums, and one document a source, at the end of the budget, is taken in part.

Defined results: null text has size 0; a null source is a source of its own, last in order; u is drawn from the
text where there is no id; rows of one id (repeated rows) share u and are taken one after the other; a source whose documents are all empty
has target 0; an empty table gives no rows; other columns of the input are ignored by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.shared import global_index, join_by_class, write_table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ROWS_A_BUCKET = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that aren't ASCII punctuation."""
    n = F.length(text)
    kept = F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.lit(0.1) + F.lit(0.9) * kept.cast("double") / n.cast("double")).otherwise(F.lit(0.1))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the keys' MD5."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Add the target of each source; ``sources`` has (skey, source_size), skey in source order.

    All sizes are shared by weight. Sources above ``cap`` times their size stop there and the
    excess is shared again among the others, by one distributed aggregate a round.
    """
    ranked = global_index(sources, [F.col("skey")], "_rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = write_table(ranked.withColumn("weight", weight).drop("_rank"), "mix-ranked")
    cap_size = F.lit(cap) * F.col("source_size")
    total, free = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    level, seen = total / free if free else 0.0, 0
    while True:
        capped = F.lit(level) * F.col("weight") > cap_size
        n, used, free = ranked.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, cap_size)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == seen or not free:
            break
        level, seen = (total - used) / free, n
    even = F.lit(level) * F.col("weight")
    return ranked.withColumn("target", F.when(even > cap_size, cap_size.cast("double")).otherwise(even))


def bucketed(drawn: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Add bucket: a bucket precedes the next in the order of key and has about ``rows_a_bucket`` rows, whatever the weights.

    Keys are counted in cells of a 64th of an octave (doubles have under 140,000 of them). Cells become runs of buckets by
    their rank among all rows, and a key's place within its cell chooses among these.
    """
    octave = F.log2(F.greatest(F.col("key"), F.lit(2.0**-1000))) * F.lit(64.0)
    cell = F.floor(octave).cast("int")
    cells = drawn.groupBy(cell.alias("cell")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = write_table(cells.select("cell", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_earlier")), "mix-cells")
    rank = F.col("_earlier") + (octave - F.floor(octave)) * F.col("_rows")
    rows = drawn.withColumn("cell", cell).join(F.broadcast(cells), "cell")
    return rows.withColumn("bucket", F.floor(rank / F.lit(float(rows_a_bucket))).cast("long")).drop("cell", "_rows", "_earlier")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, keep: list[str] | None = None, quality: Column | None = None) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (and the columns in ``keep``).

    ``quality`` is the weight of a document, a positive number; by default ``quality_weight`` of its text.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))  # "t" sorts after every source
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5("text")))  # without an id, the text tells rows apart
    drawn = docs.select(
        "doc_id", *(keep or []), skey.alias("skey"), word_count(F.col("text")).alias("size"), (-F.ln(uniform(named)) / (quality_weight(F.col("text")) if quality is None else quality)).alias("key")
    )
    drawn = bucketed(write_table(drawn, "mix-drawn"))
    sums = drawn.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("_n"))
    sums = write_table(sums, "mix-buckets")
    sources = targets(sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(sources, "skey")
    # a source's budget ends in one bucket: those before it are taken, those after it aren't, and only its rows are put in order
    edge = F.max(F.when(F.col("before") < left, F.struct("bucket", "before"))).alias("_edge")
    edges = write_table(offsets.groupBy("skey", "source_size", "target").agg(F.sum("_n").alias("_n"), edge), "mix-edges")
    rows = join_by_class(drawn, edges, "skey", "_n", edges.agg(F.sum("_n")).first()[0] or 0)
    at_edge = F.coalesce(F.col("bucket") == F.col("_edge.bucket"), F.lit(False))
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rest = left - (F.col("_edge.before") + F.sum("size").over(inside) - F.col("size"))
    ordered = rows.where(at_edge).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    others = rows.where(~at_edge).withColumn("_more", F.when(F.col("bucket") < F.col("_edge.bucket"), F.col("size")).otherwise(F.lit(0)))
    rows = others.unionByName(ordered)
    taken = epochs * F.col("size") + F.col("_more")
    return rows.select("doc_id", *(keep or []), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, quality: Column | None = None) -> DataFrame:
    """The mix itself: a row for each copy taken, the one cut in part with just the words taken."""
    columns = docs.columns
    rows = mix(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])), weights, cap, ["_row"], quality)
    rows = rows.where("taken > 0")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = rows.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    cut = (F.col("_copy") > whole) & (part > 0)
    before_spaces = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    start = F.array_join(F.slice(F.split("_row.text", before_spaces), F.lit(1), F.greatest(part, F.lit(1))), "")
    text = F.when(cut, start).otherwise(F.col("_row.text")).alias("text")
    return rows.select(*[text if c == "text" else F.col(f"_row.`{c}`") for c in columns])


def oracle_sql() -> str:
    symbols = SYMBOLS.replace("'", "''")
    return f"""
with d as (
  select doc_id, coalesce('s' || source, 't') as skey,
    case when text is null then 0 else len(regexp_extract_all(text, '{WORD}')) end as size,
    case when length(text) > 0 then 0.1::double + 0.9::double * length(translate(text, '{symbols}', ''))::double / length(text)::double else 0.1::double end as w,
    (('0x' || substr(md5(coalesce(doc_id::varchar, 'null' || md5(text), 'null')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double as u
  from documents),
s as (select skey, sum(size)::bigint as source_size, 1 + (row_number() over (order by skey) - 1) % 3 as weight from d group by skey),
r as (select *, 3 * source_size as most, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over (order by 3 * source_size::double / weight, skey rows between unbounded preceding and 1 preceding), 0) as used,
    sum(weight) over (order by 3 * source_size::double / weight, skey rows between current row and unbounded following) as free from s),
l as (select (total - used)::double / free::double as level from r
  where (total - used)::double / free::double * weight <= most order by most::double / weight, skey limit 1),
t as (select skey, source_size, case when level * weight > most then most::double else level * weight end as target from r, l),
k as (select d.*, t.source_size, t.target, round(t.target)::bigint as budget,
    sum(size) over (partition by d.skey order by -ln(u) / w, doc_id, size rows between unbounded preceding and current row) - size as before
  from d join t using (skey)),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from k)
select doc_id, size::bigint as size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken from e
"""
