"""The terminology base: protected merges, review states, injection policy, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["source_text", "target_lang", "domain"]
PROTECTED = ["approved", "rejected"]
STRATEGIES = ("skip", "overwrite", "merge", "force")
COLUMNS = ["source_text", "target_text", "source_lang", "target_lang", "domain", "confidence", "usage_count", "status"]


def action(strategy: str, status: Column, old: Column, new: Column) -> Column:
    """What an incoming term does to a stored one of the same key; a null status means there is none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    replaces = {"skip": F.lit(False), "overwrite": F.lit(True), "merge": new > old, "force": F.lit(True)}[strategy]
    free = F.lit(True) if strategy == "force" else ~status.isin(PROTECTED)
    return F.when(status.isNull(), "inserted").when(free & replaces, "overwritten").otherwise("skipped")


def upsert(stored: DataFrame, incoming: DataFrame, strategy: str) -> DataFrame:
    """The stored terms after an import whose keys are unique, with action (null: no incoming row). One full outer join on the key.

    Merge keeps the usage count, overwrite and force replace it.
    """
    new = incoming.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in COLUMNS if c not in KEY], F.lit(True).alias("n_row"))
    both = stored.select(*COLUMNS, F.lit(True).alias("o_row")).join(new, KEY, "full_outer")
    done = F.when(F.col("n_row").isNull(), None).otherwise(action(strategy, F.when(F.col("o_row"), F.col("status")), F.col("confidence"), F.col("n_confidence")))
    both = both.withColumn("action", done)
    takes = F.coalesce(F.col("action").isin("inserted", "overwritten"), F.lit(False))
    keeps_usage = F.lit(strategy == "merge") & (F.col("action") == "overwritten")
    out = {c: F.when(takes & (~keeps_usage if c == "usage_count" else F.lit(True)), F.col(f"n_{c}")).otherwise(F.col(c)) for c in COLUMNS if c not in KEY}
    return both.select(*KEY, *[v.alias(c) for c, v in out.items()], "action")


def upsert_in_order(stored: DataFrame, incoming: DataFrame, strategy: str, order: str) -> DataFrame:
    """As :func:`upsert` where a key may come several times: a key's rows are folded one after another."""
    value = lambda p: F.struct(*[F.col(c).alias(c) for c in COLUMNS if c not in KEY]).alias(p)
    rows = incoming.select(*KEY, F.struct(F.col(order).alias("o"), value("t")).alias("x")).groupBy(*KEY).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    both = stored.select(*KEY, value("t")).join(rows, KEY, "full_outer")

    def step(acc: Column, x: Column) -> Column:
        t = x["t"]
        act = action(strategy, acc["status"], acc["confidence"], t["confidence"])
        kept = F.when(F.lit(strategy == "merge") & (act == "overwritten"), acc["usage_count"]).otherwise(t["usage_count"])
        taken = F.struct(*[(kept if c == "usage_count" else t[c]).alias(c) for c in COLUMNS if c not in KEY])
        return F.when(act == "skipped", acc).otherwise(taken)

    folded = F.aggregate(F.coalesce("xs", F.array()), F.col("t"), step)
    return both.withColumn("f", folded).select(*KEY, *[F.col(f"f.{c}").alias(c) for c in COLUMNS if c not in KEY])


def transition(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """Terms after review decisions (id, decision, new_text): an edit also approves."""
    to = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "flag", "needs_review").otherwise("approved")
    joined = terms.join(changes, "id", "left")
    edited = F.when(F.col("decision") == "edit", F.col("new_text")).otherwise(F.col("target_text"))
    return joined.withColumn("target_text", edited).withColumn("status", F.when(F.col("decision").isNotNull(), to).otherwise(F.col("status"))).select(*terms.columns)


def count_usage(terms: DataFrame, used: DataFrame) -> DataFrame:
    """Adds to usage_count how often each id of ``used`` occurs."""
    n = used.groupBy("id").agg(F.count("*").alias("_n"))
    return terms.join(n, "id", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def injectable(unverified: bool = False, least: float = 0.9) -> Column:
    """Approved terms, and with the flag unverified ones of enough confidence."""
    return (F.col("status") == "approved") | (F.lit(unverified) & (F.col("status") == "unverified") & (F.col("confidence") >= least))


def statistics(terms: DataFrame) -> DataFrame:
    """Counts by language, domain and status and in all, in one pass over grouping sets."""
    sets = [[F.col("target_lang")], [F.col("domain")], [F.col("status")], []]
    g = terms.groupingSets(sets, "target_lang", "domain", "status").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    kind = F.when(F.col("g") == 3, "target_lang").when(F.col("g") == 5, "domain").when(F.col("g") == 6, "status").otherwise("total")
    return g.select(kind.alias("kind"), F.coalesce("target_lang", "domain", "status", F.lit("")).alias("value"), "n", "unverified")


def import_defaults(rows: DataFrame) -> DataFrame:
    """Imported rows with what a file may leave out; a row without source or target text is dropped."""
    defaults = {"source_lang": F.lit(""), "domain": F.lit("general"), "confidence": F.lit(1.0), "usage_count": F.lit(0).cast("long"), "status": F.lit("approved"), "target_lang": F.lit("")}
    out = [(F.coalesce(F.col(c), defaults[c]) if c in rows.columns else defaults[c]).alias(c) if c in defaults else F.col(c) for c in COLUMNS]
    return rows.select(*out).where(F.col("source_text").isNotNull() & F.col("target_text").isNotNull())


def union_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates (term, pos) of both without repeats in any case, the first one staying."""
    both = first.select("term", F.lit(0).alias("s"), "pos").unionByName(second.select("term", F.lit(1).alias("s"), "pos"))
    return both.groupBy(F.lower("term").alias("_k")).agg(F.min(F.struct("s", "pos", "term")).alias("f")).select("f.term", "f.s", "f.pos")


def sheets(terms: DataFrame) -> DataFrame:
    """Adds sheet and line: a workbook's sheet per target language, its title cut to 31 characters, lines by id."""
    return terms.withColumn("line", F.row_number().over(W.partitionBy("target_lang").orderBy("id")).cast("long")).withColumn("sheet", F.left("target_lang", F.lit(31)))


def export_json(terms: DataFrame, exported_at: Column, version: str = "1.0") -> DataFrame:
    """One row: the envelope of a whole export (version, exported_at, terms by id, without their times). For a store too large for one value, ``write_terms`` writes rows."""
    cols = [c for c in (*COLUMNS, "context_snippet") if c in terms.columns]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(*cols).alias("t")))), lambda x: x["t"])
    return terms.agg(F.to_json(F.struct(F.lit(version).alias("version"), exported_at.alias("exported_at"), listed.alias("terms"))).alias("json"))
