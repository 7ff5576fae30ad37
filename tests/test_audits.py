"""Audits: a record of each kind that passes, and for each rule group a change that it must find, and nothing else."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from weftline.audits import content as AC, materials as AM, scenes as AS
from weftline.sources.records import parse_plans


def frame(spark, kind, records):
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    return parse_plans(spark.createDataFrame(rows, "plan_id string, j string"), F.col("j"), kind).drop("j")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.entity_id, set()).add((r.rule_id, r.severity))
    return out


def changed(base, change):
    record = copy.deepcopy(base)
    change(record)
    return record


def run(spark, kind, base, cases, audit):
    """``cases``: name to (change, rules that must be broken)."""
    records = {"good": base} | {name: changed(base, change) for name, (change, _) in cases.items()}
    got = found(audit(frame(spark, kind, records)))
    assert got.get("good", set()) == set()
    for name, (_, rules) in cases.items():
        broken = {r for r, _ in got.get(name, set())}
        assert broken == set(rules), (name, broken)
    return got


CONTENT = {
    "schemaVersion": 3, "intakeMode": "hybrid", "editorialMode": "technical-single-point", "sourceMode": "faithful",
    "centralThesis": {"text": "t", "sourceIds": ["m-1"]}, "audienceValue": {"viewerNeed": "n", "promisedTakeaway": "p"},
    "claims": [{"id": "c1", "text": "a", "importance": "core", "sourceIds": ["m-1"]}, {"id": "c2", "text": "b", "importance": "supporting", "sourceIds": ["m-1"]}],
    "definitions": [{"id": "d1", "term": "x", "explanation": "y", "sourceIds": ["m-1"]}],
    "relationships": [{"id": "r1", "from": "a", "relation": "to", "to": "b", "explanation": "e", "sourceIds": ["m-1"]}],
    "examples": [], "limitations": [{"id": "l1", "text": "z", "sourceIds": ["m-1"]}],
    "technicalContract": {"propositionId": "c1", "mechanism": {"inputState": "i", "transformation": "t", "outputState": "o", "relationshipId": "r1"},
                          "proofObjects": [{"id": "p1", "kind": "trace", "authenticity": "real", "description": "d", "contentIds": ["c1"], "sourceIds": ["m-1"]}], "boundaryContentIds": ["l1"]},
}


def put(path, value):
    def change(record):
        at = record
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value

    return change


def test_content(spark):
    cases = {
        "version": (put(["schemaVersion"], 9), {"schemaVersion must be 1, 2 or 3", "technical-single-point requires schemaVersion 3"}),
        "two core": (put(["claims", 1, "importance"], "core"), {"exactly one core claim is required"}),
        "unknown source": (put(["claims", 0, "sourceIds"], ["m-9"]), {"unknown sourceId"}),
        "reused id": (put(["definitions", 0, "id"], "c1"), {"duplicate content id"}),
        "blank field": (put(["definitions", 0, "term"], "　"), {"required field is blank"}),
        "boundary": (put(["technicalContract", "boundaryContentIds"], ["c1"]), {"boundaryContentIds must reference limitations"}),
        "no limits": (put(["limitations"], []), {"limitations is empty", "boundaryContentIds must reference limitations"}),
        "proof": (put(["technicalContract", "proofObjects", 0, "contentIds"], ["zz"]), {"proof references unknown contentId"}),
        "proof kind": (put(["technicalContract", "proofObjects", 0, "kind"], "song"), {"proof kind is invalid"}),
        "thesis": (put(["centralThesis"], {"text": "", "sourceIds": []}), {"centralThesis.text is required", "centralThesis.sourceIds must be a non-empty string array"}),
        "mechanism": (put(["technicalContract", "mechanism", "relationshipId"], "c1"), {"mechanism.relationshipId must reference a relationship"}),
    }
    known = spark.createDataFrame([("m-1",)], "id string")
    got = run(spark, "content", CONTENT, cases, lambda df: AC.audit_content(df, known))
    assert ("limitations is empty", "warning") in got["no limits"]


def test_manifests(spark):
    models = frame(spark, "content", {"h": CONTENT, "p": changed(CONTENT, put(["intakeMode"], "provided-materials"))})
    local, research = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["m-1", "x"], ["r-1", "x"]))
    assert found(AC.audit_manifests(models, local, None)) == {"h": {("research sources are required", "error")}}
    assert found(AC.audit_manifests(models, local, research)) == {"p": {("provided-materials must not have research sources", "error")}, "manifests": {("source id in both manifests", "error")}}


RESEARCH = {
    "schemaVersion": 1, "intakeMode": "hybrid", "topic": "t", "researchQuestion": "q", "researchedAt": "2026-01-02T03:04:05+08:00", "researchCutoff": "2026-01-02",
    "sources": [{"id": f"r-{k}", "url": f"https://example.com/{k}", "title": "t", "publisher": "p", "sourceType": "paper", "publishedAt": None, "accessedAt": "2026-01-02T03:04:05Z", "selection": s, "evidence": [{"id": "e1", "kind": "quote", "text": "x", "locator": "p1"}], "visualUse": {"status": "cleared", "basis": "b"}} for k, s in ((1, "selected"), (2, "supporting"))],
    "conflicts": [{"topic": "c", "sourceIds": ["r-1", "r-2"], "status": "resolved", "resolution": "r"}],
}


def test_research(spark):
    cases = {
        "id": (put(["sources", 1, "id"], "x-2"), {"id must be a stable r- source id", "conflict references unknown sourceId"}),
        "user info": (put(["sources", 0, "url"], "https://u:p@example.com/"), {"url must be http or https without credentials"}),
        "same url": (put(["sources", 1, "url"], "https://example.com/1"), {"duplicate source URL"}),
        "bad day": (put(["sources", 0, "publishedAt"], "2026-02-30"), {"publishedAt must be a date"}),
        "no zone": (put(["researchedAt"], "2026-01-02T03:04:05"), {"researchedAt must be a zoned timestamp"}),
        "user": (put(["conflicts", 0, "status"], "requires-user"), {"conflict requires the user"}),
        "evidence": (put(["sources", 0, "evidence"], []), {"evidence is required for included sources"}),
        "rejected": (put(["sources", 1, "selection"], "rejected"), {"only one included source"}),
        "none": (put(["sources"], []), {"sources must be a non-empty array", "at least one source must be selected", "conflict references unknown sourceId"}),
        "analysis": (lambda r: [s.update(sourceType="analysis") for s in r["sources"]], {"no primary source type is included"}),
    }
    run(spark, "research", RESEARCH, cases, AC.audit_sources)


def scene(k, start, end, family, kind, link):
    half = (end - start) / 4
    return {
        "id": f"s{k}", "startSec": start, "endSec": end, "layoutFamily": family, "transitionIn": ["cut", "push", "fade", "wipe"][k],
        "transitionContinuity": {"type": "opening" if k == 0 else link, "outgoingAnchor": "a", "incomingAnchor": "b", "motionDirection": "left", "audioBridge": "none" if k == 0 else "j-cut", "narrativePurpose": "n", "breakReason": "r"},
        "sourceDensity": "low", "evidenceTreatment": "overview", "primaryReadingSurface": "authored", "viewerQuestion": "q", "cognitiveJob": "c", "dominantTakeaway": "d", "minPrimaryTextPx": 40, "minCaptionTextPx": 40, "captionMaxLines": 2, "contentIds": ["c1"],
        "containment": {"mode": "strict", "containerIds": ["box"], "intentionalOverflowIds": []},
        "reviewMoments": [{"phase": p, "atSec": i * half} for i, p in enumerate(AS.PHASES)],
        "beats": [{"atSec": i * (end - start) / 2, "durationSec": (end - start) / 2, "kind": kind, "actor": "a", "purpose": "p", "motion": "m"} for i in range(2)],
    }


VISUAL = {
    "schemaVersion": 4, "editorialMode": "technical-single-point", "designRead": "d", "motionThesis": "m", "sourceMode": "faithful", "audienceThesis": "a", "visualWorld": "v", "typography": "t", "colorLogic": "c", "graphicLanguage": "g", "motionGrammar": "m", "openingFrame": "o", "focalSceneId": "s1", "technicalVisualMode": "trace-demo",
    "fontPolicy": {"primaryCjkFamily": "Song", "source": "bundled", "assetPath": "f.otf", "fallbackFamilies": ["x"], "ordinaryTextUsesPrimary": True, "monospaceScopes": ["code"]},
    "dials": {"designVariance": 5, "motionIntensity": 5, "visualDensity": 5}, "colorTokens": {r: "#000" for r in AS.COLOR_ROLES}, "transitionGrammar": {"primaryFamily": "p", "accentFamilies": ["a"]}, "proofObjectIds": ["p1"],
    "scenes": [scene(0, 0, 8, "A", "state-before", "continuous"), scene(1, 8, 16, "B", "mechanism", "continuous"), scene(2, 16, 24, "C", "state-after", "deliberate-break"), scene(3, 24, 30, "A", "boundary", "continuous")],
}


def test_visual(spark):
    s = ["scenes", 1]
    cases = {
        "overlap": (put([*s, "startSec"], 7.94), {"scene overlaps the one before"}),
        "slack": (put([*s, "startSec"], 7.96), set()),
        "gap": (put([*s, "startSec"], 8.5), {"timeline gap before the scene", "beat exceeds the scene"}),
        "uncovered": (put([*s, "beats"], [{"atSec": 0, "durationSec": 3.94, "kind": "mechanism", "actor": "a", "purpose": "p", "motion": "m"}]), {"subject has an uncovered gap"}),
        "covered": (put([*s, "beats"], [{"atSec": 0, "durationSec": 3.96, "kind": "mechanism", "actor": "a", "purpose": "p", "motion": "m"}]), set()),
        "families": (lambda r: [x.update(layoutFamily="A") for x in r["scenes"][:3]], {"layoutFamily repeats too often"}),
        "phases": (put([*s, "reviewMoments", 0, "phase"], "exit"), {"reviewMoments must be the four phases in order"}),
        "unordered": (put([*s, "reviewMoments", 1, "atSec"], 0.0), {"reviewMoments must be strictly ordered"}),
        "outside": (put([*s, "reviewMoments", 3, "atSec"], 8.0), {"atSec must be inside the scene"}),
        "no beat kind": (lambda r: [b.update(kind="x") for b in r["scenes"][3]["beats"]], {"a required beat kind is missing"}),
        "opening": (put([*s, "transitionContinuity", "type"], "opening"), {"only the first scene may be opening"}),
        "anchor": (put([*s, "transitionContinuity", "outgoingAnchor"], ""), {"transitionContinuity.outgoingAnchor is required"}),
        "small": (put([*s, "minPrimaryTextPx"], 33), {"minPrimaryTextPx is too small"}),
        "boxes": (put([*s, "containment", "containerIds"], ["b", "b"]), {"containment.containerIds must not repeat"}),
        "no boxes": (put([*s, "containment", "containerIds"], []), {"strict containment requires a containerId"}),
        "dial": (put(["dials", "visualDensity"], 11), {"dials.visualDensity must be from 1 to 10"}),
        "colour": (put(["colorTokens"], {"neutral": "#0"}), {"colorTokens is missing roles"}),
        "font": (put(["fontPolicy", "assetPath"], None), {"fontPolicy.assetPath is required"}),
        "focal": (put(["focalSceneId"], "zz"), {"focalSceneId does not match a scene"}),
        "same id": (put([*s, "id"], "s2"), {"duplicate scene id", "focalSceneId does not match a scene"}),
        "unknown id": (put([*s, "contentIds"], ["zz"]), {"unknown id in contentIds"}),
        "caption": (put([*s, "captionMaxLines"], 3), {"captionMaxLines exceeds the limit"}),
        "excused": (lambda r: r["scenes"][1].update(captionMaxLines=3, qualityException="agreed"), {"captionMaxLines exceeds the limit"}),
        "mode": (put(["sourceMode"], "visual-remix"), {"sourceMode does not match the content model"}),
        "none": (put(["scenes"], []), {"scenes must be a non-empty array"}),
        "old": (lambda r: r.update(schemaVersion=1, editorialMode="general-explainer"), set()),
    }
    names = ["good", *cases]
    content = spark.createDataFrame([(n, "technical-single-point" if n != "old" else "general-explainer", "faithful") for n in names], "plan_id string, editorialMode string, sourceMode string")
    ids = spark.createDataFrame([(n, "c1") for n in names], "plan_id string, id string")
    proofs = spark.createDataFrame([(n, "p1") for n in names], "plan_id string, id string")
    got = run(spark, "visual", VISUAL, cases, lambda df: AS.audit_visual(df, content, ids, proofs))
    assert got["excused"] == {("captionMaxLines exceeds the limit", "warning")} and got["caption"] == {("captionMaxLines exceeds the limit", "error")}


def test_long_video_needs_families(spark):
    long = copy.deepcopy(VISUAL)
    long["scenes"] = [scene(k, 15 * k, 15 * k + 15, "AB"[k % 2], kind, "continuous") for k, kind in enumerate(AS.STATE_KINDS)]
    rules = {r for r, _ in found(AS.audit_visual(frame(spark, "visual", {"x": long})))["x"]}
    assert rules == {"too few layout families in a long video"} | ({"subject has an uncovered gap"} & rules)
    with pytest.raises(ValueError):
        AS.thresholds({"maxCaptionLines": 1.5})
    assert AS.thresholds({"maxCaptionLines": 0, "other": 1})["maxCaptionLines"] == 0


AUDIO = {
    "schemaVersion": 1, "editorialMode": "technical-single-point", "narration": {"priority": "primary", "duckingDb": -12}, "music": {"mode": "none"},
    "eventCues": [{"id": "e1", "sceneId": "s1", "atSec": 1.0, "event": "x", "source": "synthesized", "purpose": "p"}],
    "bridges": [{"fromSceneId": f"s{k}", "toSceneId": f"s{k + 1}", "type": "j-cut", "offsetSec": 0.5, "purpose": "p"} for k in range(3)],
    "intentionalSilences": [{"sceneId": "s0", "atSec": 7.0, "durationSec": 1.0, "purpose": "p"}],
}


def test_audio(spark):
    cases = {
        "late": (put(["eventCues", 0, "atSec"], 8.0), {"atSec must be inside the scene"}),
        "where": (put(["eventCues", 0, "sceneId"], "zz"), {"sceneId is unknown"}),
        "whence": (put(["eventCues", 0, "source"], "licensed"), {"provenanceId is required"}),
        "missing": (lambda r: r["bridges"].pop(), {"missing audio bridge"}),
        "far": (put(["bridges", 0, "toSceneId"], "s3"), {"bridge does not match an adjacent pair", "missing audio bridge"}),
        "twice": (lambda r: r["bridges"].append(r["bridges"][0]), {"duplicate audio bridge"}),
        "type": (put(["bridges", 0, "type"], "l-cut"), {"type does not match the plan's audioBridge"}),
        "silence": (put(["intentionalSilences", 0, "durationSec"], 1.1), {"silence must fit inside the scene"}),
        "duck": (put(["narration", "duckingDb"], 1), {"narration.duckingDb must be between -30 and 0"}),
        "music": (put(["music"], {"mode": "licensed"}), {"music.provenanceId is required"}),
        "no cue": (put(["eventCues"], []), {"technical-single-point requires a sound cue"}),
        "mode": (put(["editorialMode"], "general-explainer"), {"editorialMode does not match the visual plan"}),
    }
    plans = frame(spark, "visual", {n: VISUAL for n in ["good", *cases]})
    run(spark, "audio", AUDIO, cases, lambda df: AS.audit_audio(df, plans))


LAYOUT = {
    "schemaVersion": 1, "containmentTolerancePx": 1.0,
    "checks": [{"sceneId": s["id"], "phase": m["phase"], "atSec": m["atSec"], "screenshot": f"shots/{s['id']}-{m['phase']}.png", "checkedContainerIds": ["box"], "fontResult": {"primaryFamily": "Song", "loaded": True, "fallbackMismatch": False}, "blankFrame": False, "safeAreaOk": True, "captionOverlap": False, "clippedText": False, "violations": []} for s in VISUAL["scenes"] for m in s["reviewMoments"]],
    "technicalReview": {g: True for g in AS.TECHNICAL_GATES},
    "transitionChecks": [{"fromSceneId": a["id"], "toSceneId": b["id"], "midpointScreenshot": "shots/m.png", "continuityType": b["transitionContinuity"]["type"], "audioBridge": "j-cut", "anchorOrBreakOk": True, "semanticColorOk": True, "readableAtMidpoint": True} for a, b in zip(VISUAL["scenes"], VISUAL["scenes"][1:])],
}


def test_layout(spark):
    cases = {
        "missing": (lambda r: r["checks"].pop(), {"missing review check"}),
        "twice": (lambda r: r["checks"].append(r["checks"][0]), {"duplicate sceneId and phase"}),
        "time": (put(["checks", 0, "atSec"], 0.02), {"atSec does not match the visual plan"}),
        "shot": (put(["checks", 0, "screenshot"], "../x.png"), {"screenshot must be inside the review folder"}),
        "kind": (put(["checks", 0, "screenshot"], "shots/x.txt"), {"screenshot must be an image"}),
        "same shot": (put(["checks", 0, "screenshot"], "shots/s0-hold.png"), {"every review moment requires its own screenshot"}),
        "boxes": (put(["checks", 0, "checkedContainerIds"], []), {"checkedContainerIds do not match the visual plan"}),
        "font": (put(["checks", 0, "fontResult", "loaded"], None), {"primary font was not loaded"}),
        "blank": (put(["checks", 0, "blankFrame"], None), {"frame is blank"}),
        "gate": (put(["technicalReview", "proofReadable"], False), {"proofReadable must be true"}),
        "turn": (lambda r: r["transitionChecks"].pop(), {"missing transition review"}),
        "type": (put(["transitionChecks", 0, "continuityType"], "opening"), {"continuityType does not match the visual plan"}),
    }
    plans = frame(spark, "visual", {n: VISUAL for n in ["good", *cases]})
    run(spark, "layout", LAYOUT, cases, lambda df: AS.audit_layout(df, plans))


COVER = {
    "schemaVersion": 1, "platform": "universal", "specRevision": "7", "verificationMode": "user-supplied", "verificationNote": "n", "videoCanvas": {"width": 1080, "height": 1920, "ratio": "9:16"}, "title": "t", "contentIds": ["c1"], "titleLineCount": 2, "compositionMode": "authored", "fontFamily": "Song",
    "variants": [{"id": "v1", "width": 1080, "height": 1440, "ratio": "3:4", "output": "final/v1.png", "criticalArea": {"x": 60, "y": 60, "width": 900, "height": 1200}}, {"id": "v2", "width": 1000, "height": 1000, "ratio": "1:1", "output": "final/v2.png", "criticalArea": {"x": 60, "y": 60, "width": 800, "height": 800}}],
    "displayPreviews": [{"id": "d1", "width": 300, "height": 400, "ratio": "3:4", "output": "review/d1.png", "sourceVariantId": "v1"}],
}


def test_cover(spark):
    presets = spark.createDataFrame([("douyin", "variants", "v1", 1080, 1440, "3:4", "final/v1.png", None), ("xiaohongshu", "variants", "v2", 1000, 1000, "1:1", "final/v2.png", None), ("douyin", "displayPreviews", "d1", 300, 400, "3:4", "review/d1.png", "v1")], "platform string, kind string, id string, width int, height int, ratio string, output string, sourceVariantId string")
    config = {"width": 1080, "height": 1920, "aspectRatio": "9:16", "specRevision": "7", "maxTitleLines": 3, "minSafeMarginPx": 60}
    cases = {
        "missing": (lambda r: r["variants"].pop(), {"missing id in variants"}),
        "twice": (lambda r: r["variants"].append(r["variants"][0]), {"duplicate id"}),
        "size": (put(["variants", 0, "width"], 1081), {"size does not match the preset"}),
        "ratio": (put(["variants", 0, "ratio"], "4:3"), {"ratio does not match"}),
        "output": (put(["variants", 0, "output"], "../v1.png"), {"output does not match the preset", "output must be a safe path in its folder"}),
        "margin": (put(["variants", 0, "criticalArea", "x"], 59), {"criticalArea must keep its margin"}),
        "source": (put(["displayPreviews", 0, "sourceVariantId"], "v2"), {"sourceVariantId does not match the preset"}),
        "canvas": (put(["videoCanvas", "height"], 1080), {"videoCanvas does not match the configuration"}),
        "lines": (put(["titleLineCount"], 4), {"titleLineCount is out of range"}),
        "font": (put(["fontFamily"], "Kai"), {"fontFamily does not match the visual plan"}),
        "content": (put(["contentIds"], ["zz"]), {"unknown contentId"}),
        "platform": (put(["platform"], "tv"), {"platform is invalid"}),
        "one": (put(["platform"], "douyin"), {"unexpected id"}),
    }
    names = ["good", *cases]
    plans = frame(spark, "visual", {n: VISUAL for n in names})
    ids = spark.createDataFrame([(n, "c1") for n in names], "plan_id string, id string")
    run(spark, "cover", COVER, cases, lambda df: AS.audit_cover(df, presets, config, plans, ids))
    assert AS.expected_entries(presets, "universal").count() == 3 and AS.expected_entries(presets, "douyin").count() == 2


EXTRACTION = {"manifestSha256": "h", "errors": [], "items": [{"id": "m-1", "status": "extracted", "text": "x", "reviewRequirements": [], "manualObservations": []}, {"id": "m-2", "status": "manual-review-required", "text": None, "reviewRequirements": ["visual-inspection"], "manualObservations": ["seen"]}]}


def test_extraction(spark):
    manifest = spark.createDataFrame([("m-1", "text", False), ("m-2", "image", False), ("m-3", "text", True), ("m-4", "unsupported", False)], "id string, category string, exact_duplicate boolean")
    selected = spark.createDataFrame([("m-1",), ("m-2",)], "id string")
    cases = {
        "unknown": (put(["items", 0, "id"], "m-3"), {"not a current supported material", "selected material is missing", "material was not selected"}),
        "twice": (put(["items", 0, "id"], "m-2"), {"duplicate extracted material id", "selected material is missing"}),
        "no text": (put(["items", 0, "text"], " "), {"extracted but has no text"}),
        "review": (put(["items", 1, "manualObservations"], []), {"still requires manual review"}),
        "status": (put(["items", 0, "status"], "done"), {"status is invalid"}),
        "errors": (put(["errors"], [{"id": "m-2", "error": "x"}]), {"unresolved extractor errors"}),
        "hash": (put(["manifestSha256"], "g"), {"manifestSha256 does not match"}),
    }
    got = run(spark, "extraction", EXTRACTION, cases, lambda df: AM.audit_extraction(df, manifest, selected, manifest_sha256="h"))
    assert got["review"] == {("still requires manual review", "warning")}
    strict = found(AM.audit_extraction(frame(spark, "extraction", {"r": changed(EXTRACTION, cases["review"][0])}), manifest, require_reviewed=True))
    assert strict["r"] == {("still requires manual review", "error"), ("neither text nor observation", "error")}


def test_narration(spark):
    def sets(**rows):
        out = [(name, f"{name}{i}", 1, 2, rate, 2, mode, ref, control) for name, own in rows.items() for i, (rate, mode, ref, control, _) in enumerate(own)]
        samples = [(f"{name}{i}", s) for name, own in rows.items() for i, (*_, s) in enumerate(own)]
        segments = spark.createDataFrame(out, "set_id string, segment_id string, channels int, sample_width int, sample_rate int, frames long, mode string, reference_audio_sha256 string, control_instruction string")
        return found(AM.audit_narration(segments, spark.createDataFrame(samples, "segment_id string, s array<int>")))

    a = (48000, "reference", "h", None, [1000, -1000])
    got = sets(
        good=[a, (48000, "reference", "h", "c", [1500, -1500])], drift=[a, (48000, "reference", "h", None, [1700, -1700])], refs=[a, (48000, "reference", "g", None, [1000, 1000])], rate=[a, (44100, "reference", "h", None, [1000, 1000])],
        clip=[a, (48000, "reference", "h", None, [1000, -32767])], mode=[a, (48000, "design", "h", None, [1000, 1000])], alone=[(48000, None, None, None, [5, 5])], silent=[(48000, "reference", "h", None, [0, 0])], none=[a, (48000, None, None, None, [1000, 1000])],
    )
    names = {k: {r for r, _ in v} for k, v in got.items()}
    assert "good" not in names
    assert names["drift"] == {"level drift exceeds the limit"} and names["refs"] == {"segments must use one reference"} and names["rate"] == {"segments do not share one PCM format"}
    assert names["clip"] == {"clipping exceeds the limit", "level drift exceeds the limit"} and names["mode"] == {"segments must all use reference mode"}
    assert got["alone"] == {("generation manifest is missing", "warning")} and names["silent"] == {"level drift exceeds the limit"} and names["none"] == {"generation manifests are missing"}


PROBE = {"streams": [{"codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p", "avg_frame_rate": "30/1", "width": 64, "height": 96}, {"codec_type": "audio", "codec_name": "aac"}], "format": {"format_name": "mov,mp4", "duration": "2.0"}}


def test_media(spark):
    cases = {
        "rate": (put(["streams", 0, "avg_frame_rate"], "25/1"), {"frame rate does not match"}),
        "zero rate": (put(["streams", 0, "avg_frame_rate"], "0/0"), {"frame rate does not match"}),
        "two": (lambda r: r["streams"].append(r["streams"][0]), {"exactly one video stream is expected"}),
        "turned": (put(["streams", 0, "side_data_list"], [{"rotation": -90}]), {"rotation must be none"}),
        "sar": (put(["streams", 0, "sample_aspect_ratio"], "4:3"), {"pixels must be square"}),
        "sound": (lambda r: r["streams"].pop(), {"an audio stream is expected"}),
        "codec": (put(["streams", 1, "codec_name"], "mp3"), {"audio must be aac"}),
        "box": (put(["format"], {"format_name": "avi", "duration": "x"}), {"container must be mp4", "duration is missing"}),
    }
    run(spark, "probe", PROBE, cases, lambda df: AM.audit_media(df, 64, 96, 30, require_audio=True))
