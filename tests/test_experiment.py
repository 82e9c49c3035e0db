"""The benchmark's places, the experiment's shared and resumed results, against plain Python."""

import json

from pyspark.sql import functions as F

from gistmill.operators import claims as C
from gistmill.operators import experiment as X
from gistmill.operators import models as M
from gistmill.operators import synthesis as Y


def corpus(spark, n=60):
    rows = []
    for i in range(n):
        p = Y.PLATFORMS[i % 3]
        rows.append((i, p, f'Tool {i} "fails"\t on start', f"The build {i} takes {i} minutes.\nIt never ends. " + "Länge " * (i * 3)))
    rows += [(900, "other", "t", "c"), (901, "github", None, None)]
    return spark.createDataFrame(rows, "id long, platform string, title string, content string")


def made_of(spark, n=60):
    return Y.reports(Y.pairs(corpus(spark, n)))


def test_claims_are_where_the_benchmark_says(spark):
    made = made_of(spark).collect()
    assert len(made) == 30 and {r["platform"] for r in made} == set(Y.PLATFORMS)
    for r in made:
        assert [r["report_body"][c["start"] : c["end"]] for c in r["claims"]] == [c["quote"] for c in r["claims"]]
        assert all(r["report_body"].find(c["quote"]) == c["start"] for c in r["claims"])
        size, bucket = len(r["report_body"]), r["length_bucket"]
        assert size < 2500 if bucket == "short" else size >= Y.MEDIUM if bucket == "medium" else size >= Y.LONG
        assert r["flagged"] == (r["index"] % 2 == 1) and r["mutation_type"] == (Y.FLAWED if r["flagged"] else Y.CLEAN)[r["index"] % 3][0]
        assert (r["stratum"] == "controlled") == (r["index"] < 6) and len(r["sources"]) == 2
    # the second claims of long reports come after the padding
    assert all(r["claims"][1]["start"] > Y.LONG for r in made if r["length_bucket"] == "long")
    by = {k: sum(r["mutation_type"] == k for r in made) for k in {x[0] for x in (*Y.CLEAN, *Y.FLAWED)}}
    assert sum(by.values()) == 30 and len([k for k, v in by.items() if v]) == 6
    got = Y.manifest(made_of(spark)).first()
    assert (got["reports"], got["flagged"], got["clean"], got["pending"], got["complete"]) == (30, 15, 15, 12, False)


def test_pairs_of_no_and_of_odd_records(spark):
    assert Y.reports(Y.pairs(corpus(spark).where("false"))).count() == 0
    got = Y.pairs(corpus(spark).where("id in (0, 3, 6, 1)")).collect()
    assert [(r["platform"], r["index"], r["ordinal"], r["first"]["id"], r["second"]["id"]) for r in got] == [("github", 0, 0, 0, 3)]


def rule(body):
    return F.transform(C.rule_quotes(body), lambda q: F.struct(q.alias("quote"), F.lit(Y.FIRST_SECTION).alias("section")))


def plain(made):
    """extraction and evidence of each report by the same hooks, in Python."""
    import re

    out = {}
    for r in made:
        body = r["report_body"]
        quotes = list(dict.fromkeys(q.strip().rstrip("：:") for q in re.findall(C.CLAIM, body)))
        said = M.figure_claims([body])[0]
        hybrid = []
        for c in [*said, *({"quote": q, "section": Y.FIRST_SECTION} for q in quotes)]:
            like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > 0.8
            if not any(like(k["quote"], c["quote"]) for k in hybrid):
                hybrid.append(c)
        checked = {}
        for depth, n in X.EVIDENCE.items():
            shown = [f"{s['title']} {s['content'][:n] if n else ''}" for s in r["sources"]]
            asks = [json.dumps({"claim": c["quote"], "sources": shown}) for c in hybrid]
            checked[depth] = [{"verdict": "unverifiable"}] * len(hybrid) if n is None else M.overlap_checker(asks)
        out[r["id"]] = {"rule_only": quotes, "llm_only": [c["quote"] for c in said], "hybrid": [c["quote"] for c in hybrid], "checked": checked}
    return out


def run(spark, store, made, **hooks):
    h = {"extract": M.claims_as_json, "check": M.checks_as_json, "judge": M.consistency_by_words} | hooks
    return X.verifier_experiment(made, store, h["extract"], h["check"], h["judge"], rule(F.col("report_body")))


def test_experiment_against_plain_python_and_a_second_run_asks_nothing(spark, tmp_path):
    made = made_of(spark).cache()
    store = X.Store(spark, f"{tmp_path}/store")
    got, want = run(spark, store, made), plain(made.collect())
    extraction = {(r["id"], r["configuration"]): r for r in got["extraction"].collect()}
    assert len(extraction) == 90
    for i, w in want.items():
        for c in X.EXTRACTIONS:
            assert [x["quote"] for x in extraction[i, c]["claims"]] == w[c]
    evidence = got["evidence"].collect()
    asked = [i for i, w in want.items() if w["hybrid"]]
    assert len(evidence) == 4 * len(asked)
    for r in evidence:
        assert [c["verdict"] for c in r["checked"]] == [c["verdict"] for c in want[r["id"]]["checked"][r["configuration"]]] and 0 <= r["score"] <= 100
    scores = got["scores"].collect()
    assert {r["configuration"] for r in scores} == set(X.SCORES) and all(r["score"] is not None for r in scores)
    gold = {r["id"]: r["claims"] for r in made.collect()}
    metrics = {r["configuration"]: r for r in X.extraction_metrics(got["extraction"], made).collect()}
    for c in X.EXTRACTIONS:
        tp = sum(len({q["quote"] for q in gold[i]} & set(w[c])) for i, w in want.items())
        said = sum(len(set(w[c])) for w in want.values())
        assert abs(metrics[c]["precision"] - (tp / said if said else 0)) < 1e-9 and metrics[c]["reports"] == 30
    verdicts = {r["configuration"]: r for r in X.evidence_metrics(got["evidence"], got["extraction"], made).collect()}
    for depth in X.EVIDENCE:
        pairs = [(c["verdict"], w["checked"][depth][w["hybrid"].index(c["quote"])]["verdict"]) for i, w in want.items() for c in gold[i] if c["quote"] in w["hybrid"]]
        assert (verdicts[depth]["matched"], verdicts[depth]["right"]) == (len(pairs), sum(a == b for a, b in pairs))
    calls = X.call_counts(store, 30).first()
    assert (calls["planned"], calls["separate"], calls["saved"]) == (150, 600, 450)
    assert calls["asked"] <= 150 and calls["attempts"] == calls["asked"]

    def never(texts):
        raise AssertionError("asked again")

    again = run(spark, store, made, extract=never, check=never, judge=never)
    assert sorted(map(str, again["evidence"].collect())) == sorted(map(str, evidence))
    assert X.call_counts(store, 30).first() == calls


def test_failures_stay_where_they_are_and_are_asked_again_on_request(spark, tmp_path):
    rows = spark.createDataFrame([(i, "c", f"in {i % 4}") for i in range(10)], "id long, configuration string, input string")
    store = X.Store(spark, f"{tmp_path}/store")

    def broken(inputs):
        if "in 2" in inputs:
            raise ValueError("no")
        return [x.upper() for x in inputs]

    first = {r["id"]: (r["result"], r["error"]) for r in store.run(rows, "s", broken).collect()}
    assert first == {i: (None, "no") if i % 4 == 2 else (f"IN {i % 4}", None) for i in range(10)}
    # one batch for four different inputs, then each of them on its own
    assert store.calls().first()["kept"] == 4
    fine = lambda inputs: [x.upper() for x in inputs]
    assert {r["error"] for r in store.run(rows, "s", fine).collect()} == {None, "no"}
    assert {r["result"] for r in store.run(rows, "s", fine, retry_failed=True).collect()} == {"IN 0", "IN 1", "IN 2", "IN 3"}
    short = lambda inputs: inputs[:1]
    assert {r["result"] for r in store.run(rows, "t", short).collect()} == {"in 0", "in 1", "in 2", "in 3"}
    # a broken run: half of the rows are there, only the others are asked about
    half = X.Store(spark, f"{tmp_path}/half")
    half.run(rows.where("id < 2"), "s", fine)

    def only_new(inputs):
        if set(inputs) & {"in 0", "in 1"}:
            raise AssertionError("asked again")
        return fine(inputs)

    assert all(r["error"] is None for r in half.run(rows, "s", only_new).collect())
    assert store.run(rows.where("false"), "u", broken).count() == 0


def test_extraction_benchmark_asks_about_what_is_no_noise(spark, tmp_path):
    long = "the export of large projects fails with a timeout every time it is started from the menu"
    items = spark.createDataFrame([(1, "Export fails", long), (2, "ok", "thanks"), (3, "Export is slow", long + " boom"), (4, "Nothing to say about it", long + " fine")], "id long, title string, content string")
    store = X.Store(spark, f"{tmp_path}/store")

    def hook(texts):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        return ["" if "Nothing" in t else json.dumps({"title": t.split("\n")[0]}) for t in texts]

    got = {r["id"]: (r["present"], r["record"], r["error"]) for r in X.extraction_benchmark(items, store, hook).collect()}
    assert got == {1: ("yes", '{"title": "Export fails"}', None), 2: ("no", None, None), 3: ("error", None, "boom"), 4: ("no", None, None)}


def test_claims_in_batches_survive_every_fault(spark):
    claims = spark.createDataFrame([(1, i, f"quote {i}") for i in range(30)] + [(2, 0, "alone"), (3, 0, None)], "report long, claim_id int, quote string")
    sources = spark.createDataFrame([(1, "t", "x" * 500), (3, None, None)], "report long, title string, content string")

    def of(answer):
        def hook(asks):
            out = []
            for x in map(json.loads, asks):
                assert len(x["claims"]) <= 12 and all(len(s) <= 202 for s in x["sources"])
                out.append(answer(x["claims"]))
            return out

        return hook

    said = lambda c: [{"index": x["index"], "verdict": "supported", "confidence": 2.0} for x in c]
    whole = of(lambda c: json.dumps(said(c)))
    rows = M.check_in_batches(claims, sources, "report", whole).collect()
    by = {(r["report"], r["claim_id"]): (r["verdict"], r["confidence"], r["error"]) for r in rows}
    assert len(rows) == 32 and by[2, 0] == ("unverifiable", 0.3, None) and {v for k, v in by.items() if k[0] != 2} == {("supported", 1.0, None)}
    bad = lambda c: any(x["quote"] == "quote 7" for x in c)
    faults = [
        lambda c: "no json" if bad(c) else json.dumps(said(c)),
        lambda c: json.dumps({"a": 1} if bad(c) else said(c)),
        lambda c: json.dumps(said(c)[1:] if bad(c) else said(c)),
        lambda c: json.dumps([*said(c), said(c)[0]] if bad(c) else said(c)),
        lambda c: json.dumps([{**x, "index": x["index"] + 1} for x in said(c)] if bad(c) else said(c)),
        lambda c: json.dumps([{**x, "verdict": "odd"} for x in said(c)] if bad(c) else said(c)),
        lambda c: json.dumps([{**x, "confidence": "high"} for x in said(c)] if bad(c) else said(c)),
    ]
    for answer in faults:
        got = {(r["report"], r["claim_id"]): (r["verdict"], r["error"]) for r in M.check_in_batches(claims, sources, "report", of(answer)).collect()}
        assert got[1, 7][0] is None and got[1, 7][1] and all(v == ("supported", None) for k, v in got.items() if k not in ((1, 7), (2, 0)))
    assert M.check_in_batches(claims.where("false"), sources, "report", whole).count() == 0


def test_discussions_in_three_configurations(spark, tmp_path):
    long = "the export of large projects fails with a timeout every time it is started from the menu"
    items = spark.createDataFrame([(1, "Export fails", long), (2, "ok", "thanks"), (3, "Down", long + " boom"), (4, "Praise", long), (5, "Lost", long)], "id long, title string, content string")
    contexts = spark.createDataFrame([(i, f"context {i}") for i in (1, 2, 3, 4)] + [(5, "  ")], "id long, context string")
    fields = "title string, description string, pain_point string, use_case string, sentiment string, emotion string"
    gold = spark.createDataFrame([(1, "yes", "Export breaks", "d", "p", "u", "strong", "angry"), (2, "no", "", "", "", "", "mild", "neutral"), (4, "no", "", "", "", "", "mild", "neutral"), (5, "yes", "x", "", "", "", "mild", "neutral")], f"id long, present string, {fields}")
    def hook(texts):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        out = []
        for t in texts:
            title = t.split("讨论标题：")[1].split("\n")[0]
            found = "补充上下文" in t
            out.append("" if title == "Praise" and not found else json.dumps({"title": title, "description": "with context" if found else "alone", "sentiment": "strong"}))
        return out

    store = X.Store(spark, f"{tmp_path}/store")
    got = {(r["id"], r["configuration"]): r for r in X.discussion_experiment(items, contexts, gold, store, hook).collect()}
    present = {k: r["present"] for k, r in got.items()}
    assert {k: v for k, v in present.items() if k[1] == "no_rag"} == {(1, "no_rag"): "yes", (2, "no_rag"): "no", (3, "no_rag"): "error", (4, "no_rag"): "no", (5, "no_rag"): "yes"}
    assert {k: v for k, v in present.items() if k[1] == "rag"} == {(1, "rag"): "yes", (2, "rag"): "no", (3, "rag"): "error", (4, "rag"): "yes", (5, "rag"): "error"}
    assert {k: v for k, v in present.items() if k[1] == "rag_hitl"} == {(1, "rag_hitl"): "yes", (2, "rag_hitl"): "no", (3, "rag_hitl"): "error", (4, "rag_hitl"): "no", (5, "rag_hitl"): "error"}
    assert got[1, "rag"]["description"] == "with context" and got[1, "rag_hitl"]["emotion"] == "angry" and got[4, "rag_hitl"]["title"] == ""
    assert got[5, "rag"]["error"] == "no context returned" and got[3, "rag"]["error"] == "boom"
    again = X.discussion_experiment(items, contexts, gold, store, lambda texts: 1 / 0)
    assert {(r["id"], r["configuration"]): r for r in again.collect()} == got
