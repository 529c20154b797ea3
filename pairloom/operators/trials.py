"""Evidence and labels of pairs: flatten records, gather evidence, vote, label, assemble the pair table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dates as D
from ..functions import outcomes as O
from ..functions import text as T
from ..session import cut_lineage
from .columns import drop_invariant, first_columns, select_types, unnest
from .filters import available
from .joins import attach_map, left_join_or, look_up, star_join
from .ordering import group_places, keep_first, median_part, top_items


def with_outcome(df: DataFrame, p_values: str, out: str = "success") -> DataFrame:
    """Add median and outcome of each row's own list of p-values.

    Each step is a projection of its own, so the list is sorted and every statistic computed once per row.
    """
    ordered = df.withColumn("_ordered", F.array_sort(p_values))
    stats = ordered.withColumns({f"_{n}": c for n, c in O.value_stats("_ordered").items()})
    outcome = O.outcome_from_stats(F.col("_median"), F.col("_below"), F.col("_above"), F.col("_lowest"))
    decided = stats.withColumn(out, outcome).withColumnRenamed("_median", "median_p_value")
    return decided.drop("_ordered", "_below", "_above", "_lowest")


def flatten_trials(trials: DataFrame, p_mode: str = "digits") -> DataFrame:
    """Nested trial records to flat rows: id, status, phase, dates, p-values and outcome."""
    measures = F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")
    texts = F.transform(measures, lambda m: F.get(m["analyses"], F.lit(0))["pValue"])
    parsed = trials.select(
        F.col("protocolSection.identificationModule.nctId").alias("nct_id"),
        D.open_fields("protocolSection.statusModule").alias("_status"),
        A.highest_code("protocolSection.designModule.phases").alias("phase"),
        F.col("hasResults").alias("has_results"),
        F.when(F.col("hasResults"), F.array_compact(F.transform(texts, lambda p: T.p_value(p, p_mode)))).alias("_values"),
    ).withColumn("_dates", D.dates_among("_status"))
    field = lambda name: F.col("_status")[name]
    flat = parsed.select(
        "nct_id", field("overallStatus").alias("status"), "phase",
        D.earliest_date("_dates").alias("first_date"), D.latest_date("_dates").alias("last_date"),
        F.get_json_object(field("startDateStruct"), "$.date").alias("start_date"),
        F.get_json_object(field("completionDateStruct"), "$.date").alias("end_date"),
        field("whyStopped").alias("why_stopped"), "has_results", F.when(A.has_items("_values"), F.col("_values")).alias("p_values"),
    )
    return with_outcome(flat, "p_values")


def outcomes_from_rows(measures: DataFrame, key: str, p: str) -> DataFrame:
    """Outcome per key when each p-value is a row of its own.

    Equal values are counted first, so a hot key costs one row per different value; the median is read off global
    positions, so no key meets in one task.
    """
    counted = measures.filter(F.col(p).isNotNull()).groupBy(key, p).agg(F.count("*").alias("_n"))
    rows = group_places(counted, key, p, "_n")
    n, size = F.col("_n"), F.sum("_n")
    stats = rows.groupBy(key).agg(
        F.sum(median_part(p, "_n")).alias("median"),
        (F.sum(F.when(F.col(p) < O.SIGNIFICANT, n).otherwise(0)) / size).alias("below"),
        (F.sum(F.when(F.col(p) > O.DOUBTFUL, n).otherwise(0)) / size).alias("above"),
        F.min(p).alias("lowest"),
        size.alias("values"),
    )
    outcome = O.outcome_from_stats(F.col("median"), F.col("below"), F.col("above"), F.col("lowest"))
    return stats.withColumn("outcome", outcome)


def pair_evidence(
    links: DataFrame, pair: Sequence[str], child: str, children: DataFrame, outcome: str = "success", phase: str = "phase",
    first: str = "first_date", last: str = "last_date", tasks: int | None = None,
) -> DataFrame:
    """Evidence per pair from its linked child records.

    ``links`` holds one row per (pair, child); repeats count once. The result has the counts of every evidence
    tag (at most one entry per outcome and phase, however many children a pair has) and the earliest and latest
    date with sentinels when there is none. A child that is not in ``children`` adds nothing. ``tasks`` is how many tasks
    the links are dealt out to by child; without it Spark plans them by bytes.
    """
    by_child = [tasks, child] if tasks else [child]
    linked = links.select(*pair, child).repartition(*by_child).distinct()  # one shuffle serves this and the join
    known = children.select(child, outcome, phase, first, last)
    found = linked.join(known, child, "left")
    tags = found.groupBy(*pair, outcome, phase).agg(
        F.count("*").alias("_n"), F.min(first).alias("_f"), F.max(last).alias("_l")
    )
    entry = F.struct(
        T.outcome_tag(outcome, phase).alias("tag"), F.col("_n").cast("int").alias("n"),
        F.col(outcome).alias("outcome"), F.col(phase).cast("int").alias("phase"),
    )
    return tags.groupBy(*pair).agg(
        F.array_sort(F.collect_list(F.when(F.col(outcome).isNotNull(), entry))).alias("evidence"),
        F.coalesce(F.min("_f"), F.lit(D.NO_FIRST)).alias("first_date"),
        F.coalesce(F.max("_l"), F.lit(D.NO_LAST)).alias("last_date"),
    )


def evidence_list(evidence: Column | str) -> Column:
    """The tags as a plain ascending list, repeated as often as they occur."""
    return F.flatten(F.transform(F.col(evidence) if isinstance(evidence, str) else evidence,
                                 lambda e: F.array_repeat(e["tag"], e["n"])))


def with_votes(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Add the highest phase with evidence, and the wins and losses at that phase."""
    topped = df.withColumn("top_phase", F.array_max(F.transform(evidence, lambda e: e["phase"])))

    def votes(outcome: str) -> Column:
        mine = F.filter(evidence, lambda e: (e["phase"] == F.col("top_phase")) & (e["outcome"] == outcome))
        return F.aggregate(mine, F.lit(0), lambda s, e: s + e["n"])

    return topped.withColumns({"wins": votes("success"), "losses": votes("fail")})


def label_pairs(pairs: DataFrame, max_phase: str = "max_phase_for_ind", evidence: str = "evidence", last: str = "last_date") -> DataFrame:
    """Three-valued label of every pair (see ``outcomes.pair_label``)."""
    label = O.pair_label(max_phase, F.col("top_phase"), F.col("wins"), F.col("losses"), last)
    return with_votes(pairs, evidence).withColumn("overall_success", label)


def first_dates(pairs: DataFrame, pair: Sequence[str], first: str, approvals: DataFrame, left: str, year: str) -> DataFrame:
    """First date per pair, falling back to the approval year of the left entity, then to ``0000``."""
    earliest = pairs.dropna(subset=list(pair)).groupBy(*pair).agg(F.min(first).alias("_first"))
    years = approvals.select(left, D.year_text(year).alias("_year"))
    joined = left_join_or(earliest, years, left, {"_year": D.NO_FIRST})
    return joined.select(*pair, D.first_date_or("_first", "_year").alias("first_trial_date"))


def flatten_drugs(drugs: DataFrame, mechanisms: DataFrame, drop: Sequence[str] = (), rule: str = "open") -> DataFrame:
    """Left-entity records to flat rows with their targets per action type."""
    kept = available(drugs, rule=rule).drop(*drop)
    flat = unnest(kept, "molecule_properties", "molecule_structures")
    flat = flat.withColumns({
        "biotherapeutic": T.present_flag("biotherapeutic"),
        "chirality": T.recoded("chirality", T.CHIRALITY_NAMES),
        "pref_name": F.lower("pref_name"),
    })
    named = flat.withColumnsRenamed({"molecule_chembl_id": "drug_id", "pref_name": "drug_name"})
    actions = mechanisms.withColumnRenamed("molecule_chembl_id", "drug_id")
    mapped = attach_map(named, actions, "drug_id", "action_type", "uniprot_ids", "targets")
    return first_columns(mapped, "drug_id", "drug_name")


def flatten_diseases(diseases: DataFrame, top: int = 10, source: str = "uniprot_swissprot") -> DataFrame:
    """Right-entity records with the protein ids of their best-scored targets."""
    best = top_items(F.col("associatedTargets.rows"), top, "score")
    ids = A.nested_values(best, lambda r: r["target"]["proteinIds"], lambda p: p["source"] == source, lambda p: p["id"])
    return diseases.select(
        F.col("id").alias("disease_id"), F.lower("name").alias("disease_name"), "description", ids.alias("disease_targets")
    )


def target_components(targets: DataFrame, wanted_type: str = "PROTEIN", source: str = "UniProt") -> DataFrame:
    """Targets of one type with the ids of their components from one source database, where there are any."""
    ids = A.nested_values(
        "target_components", lambda c: c["target_component_xrefs"], lambda x: x["xref_src_db"] == source, lambda x: x["xref_id"]
    )
    matching = targets.filter(F.contains("target_type", F.lit(wanted_type)))
    return matching.select("target_chembl_id", ids.alias("uniprot_ids")).filter(A.has_items("uniprot_ids"))


def popularity(entities: DataFrame, key: str, facts: DataFrame, out: str) -> DataFrame:
    """Number of fact rows per entity, 0 for none (how often it is studied)."""
    counts = facts.groupBy(key).agg(F.count("*").alias(out))
    return look_up(entities, key, counts, out, 0)


def assemble_features(
    pairs: DataFrame, left: DataFrame, right: DataFrame, pair_features: DataFrame, left_id: str, right_id: str, label: str,
    left_tokens: str, right_tokens: str, order: Sequence[str] = (),
) -> DataFrame:
    """Feature matrix: labelled pairs with both sides, pair features and set similarity; no nested, text or constant columns."""
    labelled = pairs.filter(F.col(label).isNotNull())
    wide = star_join(labelled, (left, left_id), (right, right_id), (pair_features, [left_id, right_id]))
    scored = wide.withColumn("path_similarity", A.jaccard(left_tokens, right_tokens))
    flat = select_types(scored, "number", "bool", keep=[left_id, right_id]).dropna()
    once = keep_first(flat, [left_id, right_id], *(order or [c for c in flat.columns if c not in (left_id, right_id)]))
    # Which columns are constant decides the schema, so the joins are run once and their result is read twice.
    return drop_invariant(cut_lineage(once), keep=[left_id, right_id, label])


def condensed_pairs(
    scored: DataFrame, left: DataFrame, right: DataFrame, known: DataFrame, left_id: str, right_id: str, left_targets: str, right_targets: str
) -> DataFrame:
    """Every scored pair with target counts, shared targets, and what is known about the pair.

    A side without a record counts as having no targets; columns of ``known`` are null for unknown pairs.
    """
    facts = known.withColumn("is_known", F.lit(True))
    wide = (
        scored.join(left.select(left_id, left_targets), left_id, "left")
        .join(right.select(right_id, right_targets), right_id, "left")
        .join(facts, [left_id, right_id], "left")
    )
    return wide.withColumns({
        "is_known": F.coalesce("is_known", F.lit(False)),
        "n_left_targets": A.length_or_zero(left_targets),
        "n_right_targets": A.length_or_zero(right_targets),
        "n_shared_targets": A.shared_count(left_targets, right_targets),
        "target_jaccard": A.jaccard(left_targets, right_targets),
    }).drop(left_targets, right_targets)
