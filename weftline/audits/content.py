"""Audits of content models and research records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.audits.base import blank, broken, children, label, not_in
from weftline.functions.text import is_blank
from weftline.functions.values import valid_date, valid_day, valid_http_url, valid_id_array, valid_ts
from weftline.operators.checks import broken_references, union_all

# The domains of the records' fields.
SOURCE_MODES = ("editorial-recut", "faithful", "visual-remix")
INTAKE_MODES = ("provided-materials", "topic-research", "hybrid")
EDITORIAL_MODES = ("general-explainer", "technical-single-point")
PROOF_KINDS = ("trace", "code", "json", "terminal", "state-machine", "metric", "error-repair", "runtime-ui")
AUTHENTICITY = ("real", "source-derived", "labeled-simulation")
REQUIRED = {"claims": ("text",), "definitions": ("term", "explanation"), "relationships": ("from", "relation", "to", "explanation"), "examples": ("text",), "limitations": ("text",)}
SOURCE_TYPES = ("official", "documentation", "standard", "paper", "dataset", "news", "analysis", "other")
PRIMARY_TYPES = ("official", "documentation", "standard", "paper", "dataset")
SELECTIONS, EVIDENCE_KINDS = ("selected", "supporting", "rejected"), ("quote", "paraphrase", "data")
VISUAL_STATUSES, CONFLICT_STATUSES = ("cleared", "restricted", "not-cleared"), ("resolved", "requires-user")



def content_items(models: DataFrame) -> DataFrame:
    """All items of the five sections as rows: plan_id, section, pos, id, importance, sourceIds and the blank required fields."""

    def section(name: str) -> DataFrame:
        rows = children(models, name)
        lacking = F.array_compact(F.array(*[F.when(is_blank(F.col(f"`{f}`")), F.lit(f)) for f in REQUIRED[name]]))
        importance = F.col("importance") if name == "claims" else F.lit(None).cast("string")
        return rows.select("plan_id", F.lit(name).alias("section"), "pos", F.trim("id").alias("id"), importance.alias("importance"), "sourceIds", lacking.alias("lacking"))

    return union_all([section(s) for s in REQUIRED])


def _technical(models: DataFrame) -> DataFrame:
    return models.where(F.col("editorialMode") == "technical-single-point")


def audit_content(models: DataFrame, known_sources: DataFrame | None = None) -> DataFrame:
    """Violations of content models (versions 1 to 3). ``known_sources`` has the ids (column ``id``) that may be named.

    Which manifests a model needs by its intake mode is :func:`audit_manifests`.
    """
    items = content_items(models)
    place = F.concat(F.col("section"), F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    version = F.col("schemaVersion")
    out = [
        broken(models, F.lit(""), [
            ("schemaVersion must be 1, 2 or 3", not_in("schemaVersion", (1, 2, 3))),
            ("intakeMode is invalid", version.isin(2, 3) & not_in("intakeMode", INTAKE_MODES)),
            ("editorialMode is invalid", (version == 3) & not_in(F.coalesce("editorialMode", F.lit(EDITORIAL_MODES[0])), EDITORIAL_MODES)),
            ("sourceMode is invalid", not_in("sourceMode", SOURCE_MODES)),
            *blank("centralThesis.text", "audienceValue.viewerNeed", "audienceValue.promisedTakeaway"),
            ("centralThesis.sourceIds must be a non-empty string array", ~valid_id_array(F.col("centralThesis.sourceIds"))),
            *[(f"{s} must be an array", F.col(s).isNull()) for s in REQUIRED],
            ("at least one item is required", sum((F.coalesce(F.size(s), F.lit(0)) for s in REQUIRED), F.lit(0)) <= 0),
            ("limitations is empty", F.coalesce(F.size("limitations"), F.lit(0)) == 0, "warning"),
        ]),
        broken(items, place, [
            ("id is required", is_blank(F.col("id"))),
            ("required field is blank", F.size("lacking") > 0, "error", F.array_join("lacking", ",")),
            ("sourceIds must be a non-empty string array", ~valid_id_array(F.col("sourceIds"))),
            ("importance must be core or supporting", (F.col("section") == "claims") & not_in("importance", ("core", "supporting"))),
        ]),
        broken(items.where("id <> ''").groupBy("plan_id", "id").agg(F.count(F.lit(1)).alias("n")), F.col("id"), [("duplicate content id", F.col("n") > 1)]),
    ]
    technical = _technical(models)
    core = items.where("section = 'claims' and importance = 'core'").groupBy("plan_id").agg(F.collect_set("id").alias("core"))
    by_kind = items.groupBy("plan_id").agg(F.collect_set("id").alias("all_ids"), F.collect_set(F.when(F.col("section") == "relationships", F.col("id"))).alias("relations"), F.collect_set(F.when(F.col("section") == "limitations", F.col("id"))).alias("limits"))
    # the ids of one record: as many as it has items
    own = technical.join(core, "plan_id", "left").join(by_kind, "plan_id", "left")
    has = lambda ids, x: F.coalesce(F.array_contains(F.col(ids), x), F.lit(False))
    contract = "technicalContract"
    out.append(broken(own, F.lit(contract), [
        ("technical-single-point requires schemaVersion 3", ~version.eqNullSafe(3)),
        ("exactly one core claim is required", F.coalesce(F.size("core"), F.lit(0)) != 1),
        ("technicalContract is required", F.col(contract).isNull()),
        ("propositionId must reference the core claim", F.col(contract).isNotNull() & ~has("core", F.col(f"{contract}.propositionId"))),
        *[(f"mechanism.{f} is required", F.col(contract).isNotNull() & is_blank(F.col(f"{contract}.mechanism.{f}"))) for f in ("inputState", "transformation", "outputState")],
        ("mechanism.relationshipId must reference a relationship", F.col(contract).isNotNull() & ~has("relations", F.col(f"{contract}.mechanism.relationshipId"))),
        ("proofObjects must be a non-empty array", F.col(contract).isNotNull() & (F.coalesce(F.size(f"{contract}.proofObjects"), F.lit(0)) <= 0)),
        ("boundaryContentIds must be a non-empty array", F.col(contract).isNotNull() & (F.coalesce(F.size(f"{contract}.boundaryContentIds"), F.lit(0)) <= 0)),
        ("boundaryContentIds must reference limitations", F.exists(F.coalesce(F.col(f"{contract}.boundaryContentIds"), F.array().cast("array<string>")), lambda x: ~F.coalesce(F.array_contains("limits", x), F.lit(False)))),
    ]))
    proofs = children(own.select("plan_id", "all_ids", F.col(f"{contract}.proofObjects").alias("proofs")), "proofs", "all_ids")
    out.append(broken(proofs, label("proofObjects"), [
        ("proof id is required", is_blank(F.col("id"))),
        ("proof kind is invalid", not_in("kind", PROOF_KINDS)),
        ("proof authenticity is invalid", not_in("authenticity", AUTHENTICITY)),
        ("proof description is required", is_blank(F.col("description"))),
        ("proof contentIds must be a non-empty array", F.coalesce(F.size("contentIds"), F.lit(0)) <= 0),
        ("proof references unknown contentId", F.exists(F.coalesce(F.col("contentIds"), F.array().cast("array<string>")), lambda x: ~F.coalesce(F.array_contains("all_ids", x), F.lit(False)))),
        ("proof sourceIds must be a non-empty string array", ~valid_id_array(F.col("sourceIds"))),
    ]))
    out.append(broken(proofs.where("trim(id) <> ''").groupBy("plan_id", "id").agg(F.count(F.lit(1)).alias("n")), F.col("id"), [("duplicate proof object id", F.col("n") > 1)]))
    if known_sources is not None:
        cited = union_all([models.select("plan_id", F.lit("centralThesis").alias("where"), F.explode("centralThesis.sourceIds").alias("ref")), items.select("plan_id", place.alias("where"), F.explode("sourceIds").alias("ref")), proofs.select("plan_id", label("proofObjects").alias("where"), F.explode("sourceIds").alias("ref"))])
        out.append(broken(broken_references(cited, "ref", known_sources, "id"), F.col("where"), [("unknown sourceId", F.lit(True), "error", F.col("ref"))]))
    return union_all(out)


def audit_manifests(models: DataFrame, materials: DataFrame | None, research: DataFrame | None) -> DataFrame:
    """Whether the manifests that are there (tables of ``id``, or None) fit the models' intake modes, and share no id."""
    local, found = F.lit(materials is not None), F.lit(research is not None)
    mode, applies = F.col("intakeMode"), F.col("schemaVersion").isin(2, 3)
    out = [broken(models, F.lit("intakeMode"), [
        ("materials are required", applies & mode.isin("provided-materials", "hybrid") & ~local),
        ("research sources are required", applies & mode.isin("topic-research", "hybrid") & ~found),
        ("provided-materials must not have research sources", applies & (mode == "provided-materials") & found),
        ("topic-research must not have materials", applies & (mode == "topic-research") & local),
    ])]
    if materials is not None and research is not None:
        both = materials.select("id").intersect(research.select("id")).withColumn("plan_id", F.lit("manifests"))
        out.append(broken(both, F.col("id"), [("source id in both manifests", F.lit(True))]))
    return union_all(out)


def audit_sources(research: DataFrame) -> DataFrame:
    """Violations of research records."""
    sources = children(research, "sources")
    included = F.col("selection").isin("selected", "supporting")
    counts = sources.groupBy("plan_id").agg(F.count_if(F.col("selection") == "selected").alias("chosen"), F.count_if(included).alias("kept"), F.count_if(included & F.col("sourceType").isin(*PRIMARY_TYPES)).alias("prime"))
    whole = research.join(counts, "plan_id", "left").fillna(0, ["chosen", "kept", "prime"])
    good_id = F.coalesce(F.col("id").startswith("r-") & (F.length("id") > 2), F.lit(False))
    evidence = children(sources.withColumn("source_pos", F.col("pos")).drop("pos", "id"), "evidence", "source_pos")
    at = F.concat(F.lit("sources["), F.col("source_pos").cast("string"), F.lit("]."), label("evidence"))
    conflicts = children(research, "conflicts")
    twice = lambda rows, keys, path, rule: broken(rows.groupBy("plan_id", *keys).agg(F.count(F.lit(1)).alias("n")), path, [(rule, F.col("n") > 1)])
    told = conflicts.select("plan_id", "pos", F.explode("sourceIds").alias("ref"))
    unknown = told.join(sources.where(good_id).select("plan_id", F.col("id").alias("ref")).distinct(), ["plan_id", "ref"], "left_anti")
    return union_all([
        broken(whole, F.lit(""), [
            ("schemaVersion must be 1", not_in("schemaVersion", (1,))),
            ("intakeMode is invalid", not_in("intakeMode", INTAKE_MODES[1:])),
            *blank("topic", "researchQuestion"),
            ("researchedAt must be a zoned timestamp", ~valid_ts(F.col("researchedAt"))),
            ("researchCutoff must be a date", ~valid_day(F.col("researchCutoff"))),
            ("sources must be a non-empty array", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
            ("conflicts must be an array", F.col("conflicts").isNull()),
            ("at least one source must be selected", F.col("chosen") == 0),
            ("only one included source", F.col("kept") == 1, "warning"),
            ("no primary source type is included", (F.col("kept") > 0) & (F.col("prime") == 0), "warning"),
        ]),
        broken(sources, label("sources"), [
            ("id must be a stable r- source id", ~good_id),
            ("url must be http or https without credentials", ~valid_http_url(F.col("url"))),
            *blank("title", "publisher"),
            ("sourceType is invalid", not_in("sourceType", SOURCE_TYPES)),
            ("publishedAt must be a date", ~valid_date(F.col("publishedAt"))),
            ("accessedAt must be a zoned timestamp", ~valid_ts(F.col("accessedAt"))),
            ("selection is invalid", not_in("selection", SELECTIONS)),
            ("evidence is required for included sources", F.coalesce(included, F.lit(False)) & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)),
            ("visualUse.status is invalid", not_in("visualUse.status", VISUAL_STATUSES)),
            *blank("visualUse.basis"),
        ]),
        twice(sources.where(good_id), ["id"], F.col("id"), "duplicate source id"),
        twice(sources.where(valid_http_url(F.col("url"))), ["url"], F.col("url"), "duplicate source URL"),
        broken(evidence, at, [("evidence id is required", is_blank(F.col("id"))), ("evidence kind is invalid", not_in("kind", EVIDENCE_KINDS)), *blank("text", "locator")]),
        twice(evidence.where("trim(id) <> ''"), ["source_pos", "id"], F.concat(F.lit("sources["), F.col("source_pos").cast("string"), F.lit("]")), "duplicate evidence id"),
        broken(conflicts, label("conflicts"), [
            *blank("topic"),
            ("conflict needs two source ids", ~valid_id_array(F.col("sourceIds"), 2)),
            ("conflict status is invalid", not_in("status", CONFLICT_STATUSES)),
            ("conflict requires the user", F.col("status") == "requires-user"),
            ("resolution is required", (F.col("status") == "resolved") & is_blank(F.col("resolution"))),
        ]),
        broken(unknown, label("conflicts"), [("conflict references unknown sourceId", F.lit(True), "error", F.col("ref"))]),
    ])
