"""Nested record sources: schemas of the record kinds, JSON readers, id lists and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ITEM = "id string, sourceIds array<string>"
_ENTRY = "id string, width int, height int, ratio string, output string"

#: Supersets of all versions of each record kind. Schemas are stated, as empty arrays would infer wrongly.
SCHEMAS = {
    "research": "schemaVersion int, intakeMode string, topic string, researchQuestion string, researchedAt string, researchCutoff string, sources array<struct<id string, url string, title string, publisher string, sourceType string, publishedAt string, accessedAt string, selection string, evidence array<struct<id string, kind string, text string, locator string>>, visualUse struct<status string, basis string>>>, conflicts array<struct<topic string, sourceIds array<string>, status string, resolution string>>",
    "content": f"schemaVersion int, intakeMode string, editorialMode string, sourceMode string, centralThesis struct<text string, sourceIds array<string>>, audienceValue struct<viewerNeed string, promisedTakeaway string>, claims array<struct<{_ITEM}, text string, importance string>>, definitions array<struct<{_ITEM}, term string, explanation string>>, relationships array<struct<{_ITEM}, `from` string, relation string, `to` string, explanation string>>, examples array<struct<{_ITEM}, text string>>, limitations array<struct<{_ITEM}, text string>>, technicalContract struct<propositionId string, mechanism struct<inputState string, transformation string, outputState string, relationshipId string>, proofObjects array<struct<{_ITEM}, kind string, authenticity string, description string, contentIds array<string>>>, boundaryContentIds array<string>>",
    "visual": "schemaVersion int, editorialMode string, designRead string, motionThesis string, sourceMode string, audienceThesis string, visualWorld string, typography string, colorLogic string, graphicLanguage string, motionGrammar string, openingFrame string, focalSceneId string, technicalVisualMode string, fontPolicy struct<primaryCjkFamily string, source string, assetPath string, fallbackFamilies array<string>, ordinaryTextUsesPrimary boolean, monospaceScopes array<string>>, dials struct<designVariance double, motionIntensity double, visualDensity double>, colorTokens map<string, string>, transitionGrammar struct<primaryFamily string, accentFamilies array<string>>, proofObjectIds array<string>, scenes array<struct<id string, startSec double, endSec double, layoutFamily string, transitionIn string, transitionContinuity struct<type string, outgoingAnchor string, incomingAnchor string, motionDirection string, audioBridge string, narrativePurpose string, breakReason string>, sourceDensity string, evidenceTreatment string, primaryReadingSurface string, viewerQuestion string, cognitiveJob string, dominantTakeaway string, qualityException string, minPrimaryTextPx int, minCaptionTextPx int, captionMaxLines int, contentIds array<string>, containment struct<mode string, containerIds array<string>, intentionalOverflowIds array<string>>, reviewMoments array<struct<phase string, atSec double>>, beats array<struct<atSec double, durationSec double, kind string, actor string, purpose string, motion string>>>>",
    "audio": "schemaVersion int, editorialMode string, narration struct<priority string, duckingDb double>, music struct<mode string, provenanceId string>, eventCues array<struct<id string, sceneId string, atSec double, event string, source string, provenanceId string, purpose string>>, bridges array<struct<fromSceneId string, toSceneId string, type string, offsetSec double, purpose string>>, intentionalSilences array<struct<sceneId string, atSec double, durationSec double, purpose string>>",
    "layout": "schemaVersion int, containmentTolerancePx double, checks array<struct<sceneId string, phase string, atSec double, screenshot string, checkedContainerIds array<string>, fontResult struct<primaryFamily string, loaded boolean, fallbackMismatch boolean>, blankFrame boolean, safeAreaOk boolean, captionOverlap boolean, clippedText boolean, violations array<string>>>, technicalReview map<string, boolean>, transitionChecks array<struct<fromSceneId string, toSceneId string, midpointScreenshot string, continuityType string, audioBridge string, anchorOrBreakOk boolean, semanticColorOk boolean, readableAtMidpoint boolean>>",
    "cover": f"schemaVersion int, platform string, specRevision string, verificationMode string, verificationNote string, videoCanvas struct<width int, height int, ratio string>, title string, contentIds array<string>, titleLineCount int, compositionMode string, fontFamily string, variants array<struct<{_ENTRY}, criticalArea struct<x int, y int, width int, height int>>>, displayPreviews array<struct<{_ENTRY}, sourceVariantId string>>",
    "extraction": "items array<struct<id string, relativePath string, category string, sha256 string, status string, extractionMethod string, text string, textCharacters int, truncated boolean, metadata map<string, string>, reviewRequirements array<string>, manualObservations array<string>>>, manifestSha256 string, errors array<struct<id string, error string>>",
    "probe": "streams array<struct<codec_type string, codec_name string, pix_fmt string, avg_frame_rate string, r_frame_rate string, sample_aspect_ratio string, width int, height int, tags struct<rotate string>, side_data_list array<struct<rotation double>>>>, format struct<format_name string, duration string>",
}


def read_plans(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row for each JSON file, which holds one object: its fields, ``plan_id`` (the file) and ``corrupt`` (the text of a
    file that is no such object, or has a value of the wrong type, which is null then). A byte order mark is skipped."""
    return spark.read.schema(SCHEMAS[kind] + ", corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path).withColumn("plan_id", F.input_file_name())


def parse_plans(df: DataFrame, text: Column, kind: str) -> DataFrame:
    """``df`` with the record in a JSON column spread out."""
    return df.withColumn("__r", F.from_json(text, SCHEMAS[kind])).select("*", "__r.*").drop("__r")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line, trimmed; blank lines and repetitions are dropped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^[\s\x{FEFF}]+|\s+$", "").alias("id")).where("id <> ''").distinct()


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Records as JSON or Parquet; Spark publishes the files when all are written."""
    df.write.format(fmt).mode(mode).save(path)
