"""Resolve measured-column names to identities by a priority cascade that never guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.text import lookup_key, split_key, strip_decoration

# Order in which sources answer; a conflict inside one source stops the cascade.
SOURCE_ORDER = {"symbol": 0, "alias": 1, "previous": 2}


def parse_names(df: DataFrame, raw: str = "raw_column") -> DataFrame:
    """stripped, core, epitope, modification and lookup key of each raw name."""
    d = df.withColumn("stripped", strip_decoration(raw))
    k = split_key("stripped")
    return (d.withColumn("core", k["core"]).withColumn("epitope", k["epitope"])
            .withColumn("modification", k["modification"]).withColumn("key", lookup_key("core")))


def spellings(core: str | Column) -> Column:
    """Spelling variants tried against the symbol tables."""
    c = F.col(core) if isinstance(core, str) else core
    v = F.array(c, F.regexp_replace(c, "-", ""), F.regexp_replace(c, "-", " "),
                F.regexp_replace(c, " ", "-"), F.regexp_replace(c, "_", "-"), F.upper(c))
    return F.array_distinct(F.filter(v, lambda s: s != ""))


def symbol_hits(cores: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per core: the first source that answers, with symbol/id or a conflict note.

    symbols: source, spelling, symbol, id. A spelling with several hits is no answer; spellings
    that answer differently are a conflict.
    """
    tried = cores.select("core", F.explode(spellings("core")).alias("spelling"))
    one = (tried.join(symbols, "spelling").groupBy("core", "source", "spelling")
           .agg(F.count(F.lit(1)).alias("hits"), F.min("symbol").alias("symbol"), F.min("id").alias("id"))
           .where("hits = 1"))
    per_source = one.groupBy("core", "source").agg(
        F.countDistinct("symbol").alias("k"), F.min("symbol").alias("symbol"), F.min("id").alias("id"),
        F.array_join(F.array_sort(F.collect_set("symbol")), "|").alias("all_symbols"))
    order = F.lit(99)
    for s, p in SOURCE_ORDER.items():
        order = F.when(F.col("source") == s, p).otherwise(order)
    first = per_source.groupBy("core").agg(
        F.min_by(F.struct("source", "k", "symbol", "id", "all_symbols"), order).alias("b"))
    ok = F.col("b.k") == 1
    return first.select(
        "core", F.when(ok, F.col("b.symbol")).alias("sym_gene"), F.when(ok, F.col("b.id")).alias("sym_id"),
        F.when(ok, F.col("b.source")).alias("sym_source"),
        F.when(~ok, F.concat(F.col("b.source"), F.lit("_conflict:"), F.col("b.all_symbols"))).alias("sym_note"))


def protein_hits(cores: DataFrame, proteins: DataFrame) -> DataFrame:
    """Protein-name answers: unambiguous gene, or the top hit when its name equals the query.

    proteins: query, rank, gene, accession, name.
    """
    t = cores.select("core").join(proteins.withColumnRenamed("query", "core"), "core").where("gene <> ''")
    g = t.groupBy("core").agg(
        F.min_by(F.struct("gene", "accession", "name"), "rank").alias("top"),
        F.min_by("gene", F.when(F.col("rank") > 1, F.col("rank"))).alias("second"))
    exact = lookup_key("top.name") == lookup_key("core")
    ok = F.col("second").isNull() | (F.col("second") == F.col("top.gene")) | exact
    return g.select(
        "core", F.when(ok, F.col("top.gene")).alias("prot_gene"),
        F.when(ok, F.concat(F.lit("protein:"), F.col("top.accession"))).alias("prot_id"),
        F.when(~ok, F.concat(F.lit("protein_ambiguous:"), F.col("top.gene"), F.lit("|"), F.col("second"))).alias("prot_note"))


def resolve(parsed: DataFrame, complexes: DataFrame, overrides: DataFrame, symbols: DataFrame,
            proteins: DataFrame | None = None) -> DataFrame:
    """complex table -> override -> symbol -> alias -> previous symbol -> protein name -> unresolved.

    complexes: key, name, kind, members; overrides: key, gene, id. Adds resolved_id, gene, kind,
    source, note and the identity triple id|epitope|modification.
    """
    cores = parsed.select("core", "key").distinct()
    d = cores.join(complexes.select("key", F.col("name").alias("cx_name"), F.col("kind").alias("cx_kind"),
                                    F.col("members").alias("cx_gene")), "key", "left")
    d = d.join(overrides.select("key", F.col("gene").alias("ov_gene"), F.col("id").alias("ov_id")), "key", "left")
    d = d.join(symbol_hits(cores, symbols), "core", "left")
    if proteins is not None:
        d = d.join(protein_hits(cores, proteins), "core", "left")
    else:
        for c in ("prot_gene", "prot_id", "prot_note"):
            d = d.withColumn(c, F.lit(None).cast("string"))
    is_cx = F.col("cx_name").isNotNull()
    group = F.col("cx_kind").isin("COMPLEX", "FAMILY")

    def ident(i: Column, g: Column) -> Column:
        return F.coalesce(F.when(i != "", i), F.concat(F.lit("GENE:"), g))

    def answer(rid: Column, gene: Column, kind: Column, source: Column, note: Column) -> Column:
        return F.struct(rid.alias("resolved_id"), gene.alias("gene"), kind.alias("kind"),
                        source.alias("source"), note.alias("note"))

    none = F.lit("")
    a = (
        F.when(is_cx, answer(F.concat_ws(":", "cx_kind", "cx_name"), F.when(group, F.col("cx_gene")).otherwise(none),
                             F.when(group, F.lit("complex")).otherwise(F.lit("non_protein")), F.lit("complex_table"), none))
        .when(F.col("ov_gene").isNotNull(), answer(ident(F.col("ov_id"), F.col("ov_gene")), F.col("ov_gene"),
                                                   F.lit("protein"), F.lit("manual"), none))
        .when(F.col("sym_gene").isNotNull(), answer(ident(F.col("sym_id"), F.col("sym_gene")), F.col("sym_gene"),
                                                    F.lit("protein"), F.col("sym_source"), none))
        .when(F.col("prot_gene").isNotNull(), answer(F.col("prot_id"), F.col("prot_gene"), F.lit("protein"),
                                                     F.lit("protein_name"), none))
        .otherwise(answer(none, none, F.lit("unknown"), F.lit("unresolved"),
                          F.coalesce("sym_note", "prot_note", F.lit("no_hit"))))
    )
    out = d.select("core", "key", a.alias("_a")).select("core", "key", "_a.*")
    return parsed.join(out, ["core", "key"]).withColumn(
        "triple", F.when(F.col("resolved_id") != "", F.concat_ws("|", "resolved_id", "epitope", "modification"))
        .otherwise(none))


def coverage(registry: DataFrame) -> DataFrame:
    """Columns per (kind, source) with their share of all columns, in percent."""
    n = registry.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("columns"))
    total = F.sum("columns").over(Window.partitionBy(F.lit(0)))  # a handful of rows
    return n.withColumn("share_pct", 100.0 * F.col("columns") / total)


def sharing(registry: DataFrame) -> DataFrame:
    """Distinct markers and those in >= 2 cohorts, by verbatim name and by resolved triple."""
    def one(key: str, method: str) -> DataFrame:
        return (registry.where(F.col(key) != "").groupBy(key).agg(F.countDistinct("cohort").alias("k"))
                .agg(F.count(F.lit(1)).alias("markers"), F.count_if(F.col("k") >= 2).alias("shared"))
                .select(F.lit(method).alias("method"), "markers", "shared"))
    return one("raw_column", "verbatim").unionByName(one("triple", "resolved"))


def availability(registry: DataFrame, cohorts: list[str]) -> DataFrame:
    """Triple x cohort 0/1 matrix with the number of cohorts."""
    real = registry.where("triple <> '' AND kind <> 'non_protein'")
    p = real.groupBy("triple").pivot("cohort", cohorts).agg(F.lit(1))
    p = p.na.fill(0, cohorts)
    total = F.lit(0)
    for c in cohorts:
        total = total + F.col(f"`{c}`")
    return p.withColumn("n_cohorts", total)


def availability_distribution(registry: DataFrame, levels: list[int]) -> DataFrame:
    """Markers present in at least N cohorts, for each N."""
    real = registry.where("triple <> '' AND kind <> 'non_protein'")
    n = real.groupBy("triple").agg(F.countDistinct("cohort").alias("k"))
    return (n.withColumn("at_least", F.explode(F.lit(levels)))
            .groupBy("at_least").agg(F.count_if(F.col("k") >= F.col("at_least")).alias("markers")))


def review_queue(registry: DataFrame) -> DataFrame:
    """Unresolved names with the cohorts that carry them."""
    return registry.where("kind = 'unknown'").groupBy("stripped", "core", "note").agg(
        F.array_join(F.array_sort(F.collect_set("cohort")), ", ").alias("cohorts"))


def _lookup(registry: DataFrame) -> DataFrame:
    """Lookup key of raw and stripped names -> triple (first in cohort, column order)."""
    both = registry.select(
        "cohort", "raw_column", "triple",
        F.explode(F.array(lookup_key("raw_column"), lookup_key("stripped"))).alias("lk"))
    return both.groupBy("lk").agg(F.min_by("triple", F.struct("cohort", "raw_column")).alias("triple"))


def check_never_merge(registry: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs (a, b) that must resolve to different triples."""
    lk = _lookup(registry)
    d = (rules.withColumn("ka", lookup_key("a")).withColumn("kb", lookup_key("b"))
         .join(lk.select(F.col("lk").alias("ka"), F.col("triple").alias("triple_a")), "ka", "left")
         .join(lk.select(F.col("lk").alias("kb"), F.col("triple").alias("triple_b")), "kb", "left"))
    status = (F.when(F.col("triple_a").isNull() | F.col("triple_b").isNull(), "NOT IN DATA")
              .when((F.col("triple_a") == "") | (F.col("triple_b") == ""), "UNRESOLVED")
              .when(F.col("triple_a") != F.col("triple_b"), "PASS").otherwise("FAIL"))
    return d.select("a", "b", F.coalesce("triple_a", F.lit("-")).alias("triple_a"),
                    F.coalesce("triple_b", F.lit("-")).alias("triple_b"), status.alias("status"))


def check_must_merge(registry: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups whose |-joined spellings must resolve to one triple; unresolved members fail."""
    m = rules.select("group", F.explode(F.split("members", r"\|")).alias("m"))
    m = m.withColumn("lk", lookup_key(F.trim("m"))).join(_lookup(registry), "lk", "left")
    g = m.groupBy("group").agg(
        F.count(F.lit(1)).alias("of"), F.count("triple").alias("in_data"),
        F.countDistinct("triple").alias("distinct_triples"),
        F.coalesce(F.bool_or(F.col("triple") == ""), F.lit(False)).alias("_u"))
    status = (F.when(F.col("in_data") == 0, "NOT IN DATA").when(F.col("_u"), "FAIL (unresolved)")
              .when(F.col("distinct_triples") == 1, "PASS").otherwise("FAIL"))
    return g.select("group", "in_data", "of", "distinct_triples", status.alias("status"))


def non_protein_leak(registry: DataFrame, complexes: DataFrame) -> DataFrame:
    """Columns whose core is a declared element, dye or artefact yet resolved to a protein."""
    bad = complexes.where(F.col("kind").isin("ELEMENT", "DYE", "ARTEFACT")).select("key").distinct()
    return registry.where("kind = 'protein'").join(bad, "key", "left_semi")
