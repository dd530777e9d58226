"""Secret scans with corpus-wide ownership, in column expressions only.

Patterns find base spans (assign, access, hex); any other long mixed token is a candidate too. The hashes of all candidates (of an
assign span its value) are counted by distinct repositories (``source``) and owners (a source's name before its first /; one without a / is its own owner)
in the whole corpus: what one owner holds, in however many repositories, looks live; what several owners hold is a copied example.
Each span gets its counts and that flag; base spans stay either way, live tokens are added (kind ``owned``). Counts combine before the shuffle; hashes that hold over 1/HOT of all candidate rows (so at most HOT of them) are broadcast.

Spans are whole matches in code points, end exclusive. Defined results: null text is empty; empty texts have no spans and the hash
of an empty string; null sources are one repository; rows are told apart by numbers of their own, so null and repeated doc_ids are no
matter; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table

# The patterns of the base kinds with their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
HOT, STEPS = 512, 128


def spans(text: Column, pattern: str, kind: int, fails) -> Column:
    """array<struct<s, k, e, m>> of a pattern's leftmost non-overlapping matches, failing ones dropped after matching."""
    whole = pattern
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    gaps = F.transform(F.split(text, whole, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    steps = F.filter(steps, lambda x: x.m.isNotNull())
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")

    def block(part: Column) -> Column:
        """The matches of a few steps, placed from the first one's gap on, and the length of all."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc.at + x.g + F.length(x.m)).alias("at"),
                F.when(fails(x.m), acc.out)
                .otherwise(F.concat(acc.out, F.array(F.struct((acc.at + x.g).cast("int").alias("s"), F.lit(kind).alias("k"), (acc.at + x.g + F.length(x.m)).cast("int").alias("e"), x.m.alias("m")))))
                .alias("out"),
            ),
        )

    def placed(all_steps: Column) -> Column:
        """Blocks of STEPS matches one after the other, so that no long array is copied for each match."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / STEPS).cast("int")), lambda k: block(F.slice(all_steps, k * STEPS + 1, STEPS)))
        moved = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,k:int,e:int,m:string>>>").alias("out")),
            lambda acc, x: F.struct(
                (acc.at + x["at"]).alias("at"),
                F.concat(acc.out, F.array(F.transform(x.out, lambda y: F.struct((y.s + acc.at).cast("int").alias("s"), y.k.alias("k"), (y.e + acc.at).cast("int").alias("e"), y.m.alias("m"))))).alias("out"),
            ),
            lambda acc: F.flatten(acc.out),
        )
        return F.when(F.size(all_steps) > 0, moved).otherwise(none)

    out = F.element_at(F.transform(F.array(steps), placed), 1)
    # most texts hold no match: they skip the fold
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>"))


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(kinds, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def ownership(held: Column) -> Column:
    """kind:start:end:repositories:owners:live or copied of each candidate by start, then kind, comma-joined; kind ``owned`` is a token."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    flag = lambda x: F.when(x.live, "live").otherwise("copied")
    return F.array_join(F.transform(F.array_sort(held), lambda x: F.concat_ws(":", F.element_at(kinds, x.k + 1), x.s.cast("string"), x.e.cast("string"), x.repositories.cast("string"), x.owners.cast("string"), flag(x))), ",")


def candidates(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with a number for each row, its base spans and all its candidates with hashes, written once; and the three columns' names."""
    row, base, held, text = fresh(docs.columns, "row", "base", "held", "whole")
    value = F.regexp_extract
    secret = lambda m, k: F.when(k == 0, value(m, ASSIGN, 1)).otherwise(m)
    out = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn(
        base,
        F.concat(
            spans(F.col(text), ASSIGN, 0, lambda m: F.length(value(m, ASSIGN, 1)) < 6),
            spans(F.col(text), ACCESS, 1, lambda m: F.length(m) < 20),
            spans(F.col(text), r"[0-9a-f]{24,}", 2, lambda m: F.length(m) < 24),
        ),
    )
    out = out.withColumn(held, spans(F.col(text), TOKEN, 3, lambda m: ~(m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"))))
    # a token that a base span covers is already found
    free = F.filter(held, lambda t: ~F.exists(F.col(base), lambda b: (b.s <= t.s) & (b.e >= t.e)))
    found = F.transform(F.concat(base, free), lambda t: F.struct(t.s.alias("s"), t.k.alias("k"), t.e.alias("e"), F.xxhash64(secret(t.m, t.k)).alias("h")))
    plain = F.transform(base, lambda b: F.struct(b.s.alias("s"), b.k.alias("k"), b.e.alias("e")))
    return out.select(*docs.columns, row, plain.alias(base), found.alias(held)), [row, base, held]


def counted(found: DataFrame, row: str, source: Column, held: str) -> DataFrame:
    """(row, held): the candidates of each row that has some, with their repositories, owners and whether they look live."""
    each = found.where(F.size(held) > 0).select(F.col(row).alias("row"), F.coalesce(source.cast("string"), F.lit("")).alias("source"), F.explode(held).alias("t"))
    each = each.select("row", "source", "t", F.col("t.h").alias("h"))
    owner = F.substring_index("source", "/", 1)
    repos = each.groupBy("h", "source").agg(F.count("*").alias("n"))
    freq = repos.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"), F.count_distinct(owner).alias("owners"))
    freq = materialize(freq, "owners")
    total = freq.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = total // HOT + 1
    hot, cold = F.broadcast(freq.where(F.col("n") >= cut)), freq.where(F.col("n") < cut)
    often = each.join(hot, "h")
    rare = each.join(F.broadcast(freq.where(F.col("n") >= cut).select("h")), "h", "left_anti").join(cold, "h")
    one = F.struct("t.s", "t.k", "t.e", "repositories", "owners", (F.col("owners") == 1).alias("live"))
    return often.unionByName(rare).groupBy("row").agg(F.collect_set(one).alias("held"))


def _added(held: Column) -> Column:
    return F.transform(F.filter(held, lambda x: (x.k == 3) & x.live), lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base spans, added spans, and all candidates with their counts (held)."""
    found, (row, base, held) = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))
    found = materialize(found.select("doc_id", "source", row, base, held), "spans")
    counts = counted(found, row, F.col("source"), held).withColumnRenamed("held", "counts")
    none = F.array().cast("array<struct<s:int,k:int,e:int,repositories:bigint,owners:bigint,live:boolean>>")
    out = found.join(counts, found[row] == counts["row"], "left").select("doc_id", F.col(base).alias("base"), F.coalesce("counts", none).alias("held"))
    return out.select("doc_id", "base", _added(F.col("held")).alias("added"), "held")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        ownership(F.col("held")).alias("ownership"),
    )


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets become <SECRET> in the text; no document goes. Keeps the columns of docs, n_chars renewed.

    Each found span (base or owned) is cut from the text of its own row; overlapping spans are one mark. Only rows with candidates
    besides base spans wait for the counts, the others are cut where they lie."""
    found, (row, base, held) = candidates(docs)
    found = materialize(found, "spans")
    (live,) = fresh(found.columns, "live")
    waits = F.exists(held, lambda x: x.k == 3)
    counts = counted(found, row, F.col("source"), held).select(F.col("row").alias(row), _added(F.col("held")).alias(live))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    rows = found.where(~waits).withColumn(live, none).unionByName(found.where(waits).join(counts, row, "left").withColumn(live, F.coalesce(live, none)).select(*found.columns, live))
    cut = F.aggregate(
        F.array_sort(F.concat(base, live)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x.s < a.at, F.struct(F.greatest(a.at, x.e).alias("at"), a.out.alias("out"))).otherwise(
            F.struct(x.e.alias("at"), F.concat(a.out, F.substring(F.col("text"), a.at + 1, x.s - a.at), F.lit("<SECRET>")).alias("out"))
        ),
        lambda a: F.concat(a.out, F.substring(F.col("text"), a.at + 1, F.length("text"))),
    )
    out = rows.withColumn("text", F.when(F.size(base) + F.size(live) > 0, cut).otherwise(F.col("text")))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)
