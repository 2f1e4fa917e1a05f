"""Operators on small tables made for one intention each."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import instants, numbers, text, vectors
from oscilla.operators import contract, documents, evaluation, lifecycle, neighbours, outcomes, profile, quality, quantiles, retrieval, sessions, split
from oscilla.sources import files, readings
from oscilla.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_instants(spark):
    cases = {
        "2024-01-02T03:04:05Z": "2024-01-02T03:04:05.000000Z", "2024-01-02 03:04:05.1234567+02:30": "2024-01-02T00:34:05.1234567Z", "2024-01-02T03:04:05-00:00": None,
        "2024-01-02T03:04:05": None, "2024-13-02T03:04:05Z": None, "2024-01-02T03:04:05+24:00": None, "nonsense": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", instants.canonical(instants.parse(F.col("t"))).alias("c")).collect()}
    assert got == cases
    a, b = "2024-01-01T00:00:00.000000000000000001Z", "2024-01-01T00:00:10Z"
    gap = spark.createDataFrame([(a, b)], "a string, b string").select(instants.since(instants.parse(F.col("b")), instants.parse(F.col("a"))).alias("g")).first()["g"]
    assert str(gap) == "9.999999999999999999"


def test_numbers(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (1, 10**9), (5, 5)], "n long, d long")
    assert [r[0] for r in df.select(numbers.percentage(F.col("n"), F.col("d"))).collect()] == [None, 33.333333, None, 100.0]
    low, high = df.where("d = 3").select(numbers.wilson(F.col("n"), F.col("d")).alias("w")).select("w.*").first()
    z = 1.959963984540054
    p, n = 1 / 3, 3
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    assert abs(low - (centre - half)) < 1e-12 and abs(high - (centre + half)) < 1e-12
    public = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (1e-9,), (2.0000005,)], "x double").select(numbers.public_number(F.col("x")).alias("y")).collect()
    assert [r[0] for r in public] == [None, None, 0.0, None, 2.0]


def test_order_statistics_differ(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    assert profile.order_statistic(df, "x", 0.95, "higher").first()[0] == 19.0
    assert profile.order_statistic(df, "x", 0.95, "lower").first()[0] == 18.0
    assert df.selectExpr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").first()[0] == 18.0


def test_profile_of_nulls_nan_and_equal_values(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, float("nan")), (1.0, float("inf")), (1.0, 2.0)], "a double, b double")
    done = {r["column_name"]: r for r in profile.completeness(df).collect()}
    assert (done["b"]["nulls"], done["b"]["nans"], done["b"]["infinities"], done["b"]["observed"]) == (1, 1, 1, 2)
    stats = {r["column_name"]: r for r in profile.numeric(df, ["a", "b"]).collect()}
    assert stats["a"]["iqr"] == 0 and stats["a"]["outliers"] == 0 and stats["b"]["n"] == 1


def reading(spark, n=3, **over):
    rows = []
    for i in range(n):
        base = {c.name: 1.0 for c in readings.CONTRACT} | {"id": i, "created_at": f"2024-01-01T00:0{i}:00Z", "fault": "ok", "temperature_c": 20.0, "temperature_f": 68.0}
        for t, o in (("z_rms_velocity_mm_s", "z_rms_velocity_in_s"), ("x_rms_velocity_mm_s", "x_rms_velocity_in_s"), ("z_peak_velocity_mm_s", "z_peak_velocity_in_s"), ("x_peak_velocity_mm_s", "x_peak_velocity_in_s")):
            base[t], base[o] = 25.4, 1.0
        rows.append(base)
    for k, v in over.items():
        rows[0][k] = v
    return spark.createDataFrame([tuple(r[c.name] for c in readings.CONTRACT) for r in rows], readings.SCHEMA)


@pytest.mark.parametrize(
    ("change", "code"),
    [({}, None), ({"rpm": None}, "null"), ({"rpm": float("nan")}, "nan"), ({"rpm": float("inf")}, "infinity"), ({"temperature_c": -300.0}, "outside_domain"), ({"created_at": "2024-01-01T00:00:00"}, "outside_domain"), ({"fault": "  "}, "outside_domain"), ({"fault": "new"}, "label_not_allowed")],
)
def test_contract_values(spark, change, code):
    found = contract.report(reading(spark, **change), allowed=["ok", "  "]).collect()
    assert [r["code"] for r in found] == ([code] if code else [])


def test_contract_structure(spark):
    df = reading(spark)
    assert [r["code"] for r in contract.report(df.drop("rpm")).collect()] == ["column_missing"]
    assert [r["code"] for r in contract.report(df.withColumn("more", F.lit(1))).collect()] == ["column_unexpected"]
    assert [r["code"] for r in contract.report(df.withColumnRenamed("rpm", "speed")).collect()] == ["column_renamed"]
    assert [r["code"] for r in contract.report(df.select("fault", *(c for c in df.columns if c != "fault"))).collect()] == ["column_order"]
    assert [r["code"] for r in contract.report(df.withColumn("rpm", F.col("rpm").cast("string"))).collect()] == ["wrong_type"]


@pytest.mark.parametrize(
    ("change", "disposition", "rule"),
    [({}, "kept", None), ({"temperature_f": 99.0}, "corrected", "unit.inconsistent.deterministic"), ({"id": 1}, "rejected", "duplicate.conflicting.reject"), ({"rpm": None}, "rejected", "required.measurement.missing"), ({"x_kurtosis": float("nan")}, "rejected", "measurement.non_finite"), ({"temperature_c": -274.0}, "rejected", "physical.temperature_c.absolute_zero")],
)
def test_ledger(spark, change, disposition, rule):
    made = quality.resolve(quality.matches(reading(spark, **change))).orderBy("created_at").first()
    assert made["disposition"] == disposition and (rule is None or rule in made["rules"])


def test_identical_rows_differing_in_label_only_are_mapped(spark):
    df = reading(spark, 1)
    both = df.unionByName(df.withColumn("fault", F.lit("other")))
    assert {r["disposition"] for r in quality.resolve(quality.matches(both)).collect()} == {"mapped"}


def test_gap_equal_to_threshold_joins_and_duration_breaks(spark):
    df = spark.createDataFrame([(0, 0), (10, 1), (20, 2), (31, 3), (41, 4), (41, 5)], "at long, position long")
    got = [r["session"] for r in sessions.gap_sessions(df, 10, stretch=2).orderBy("position").collect()]
    assert got == [1, 1, 1, 2, 2, 2]
    limited = sessions.limit_duration(df.withColumn("session", F.lit(1).cast("long")), 20).orderBy("position").collect()
    assert [r["part"] for r in limited] == [1, 1, 2, 2, 3, 3]


def plain_fixed_point(at: list[int], limit: int):
    """The same fit, row by row."""
    threshold, seen = -1.0, set()
    for _ in range(64):
        groups = [[at[0]]]
        for x in at[1:]:
            if x - groups[-1][-1] > threshold or x - groups[-1][0] >= limit:
                groups.append([x])
            else:
                groups[-1].append(x)
        ends = np.cumsum([len(g) for g in groups])
        first = min(range(1, len(groups) - 1), key=lambda b: (abs(ends[b - 1] - ends[-1] * 0.7), b))
        second = min(range(first + 1, len(groups)), key=lambda b: (abs(ends[b - 1] - ends[-1] * (0.7 + 0.15)), b))
        parts = ["train"] * first + ["validation"] * (second - first) + ["test"] * (len(groups) - second)
        purge = [False] * len(groups)
        for low, cut in ((0, first), (first, second)):
            for i in reversed(range(low, cut)):
                d = groups[cut][0] - groups[i][-1]
                if d > 0 and d >= max(threshold, 0):
                    break
                purge[i] = True
        last = max(i for i in range(first) if not purge[i])
        train = [x for g in groups[: last + 1] for x in g]
        gaps = [b - a for a, b in zip(train, train[1:]) if b > a]
        fitted = max(5 * np.quantile(gaps, 0.5), np.quantile(gaps, 0.95)) if gaps else 0.0
        if fitted == threshold:
            return threshold, {d: sum(len(g) for g, p, q in zip(groups, parts, purge) if ("purge" if q else p) == d) for d in ("train", "validation", "test", "purge")}
        if (fitted, last) in seen:
            raise ValueError
        seen.add((fitted, last))
        threshold = fitted
    raise ValueError


@pytest.mark.parametrize("limit", [86_400_000_000, 3_600_000_000])
def test_fixed_point_split(spark, small, limit):
    rows = spark.read.parquet(f"{small}/events.parquet").select(instants.micros(F.col("ts")).alias("at"), F.col("event_id").alias("position"))
    wanted = plain_fixed_point(sorted(r["at"] for r in rows.collect()), limit)
    threshold, made = split.fixed_point(rows, limit)
    got = {r["d"]: r["n"] for r in made.groupBy(F.coalesce("partition", "exclusion").alias("d")).agg(F.sum("n").alias("n")).collect()}
    assert abs(threshold - wanted[0]) < 1e-6 and got == {k: v for k, v in wanted[1].items() if v}


def test_neighbours_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, q = rng.integers(0, 4, (60, 3)).astype(float), rng.integers(0, 4, (9, 3)).astype(float)
    train = spark.createDataFrame([(i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "ref long, label int, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["ref"] for r in neighbours.ranked(queries, train).collect()}
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        for rank, ref in enumerate(np.lexsort((np.arange(60), d))[:5], 1):
            assert got[i, rank] == ref
    voted = neighbours.voted(spark.createDataFrame([(1, 1, 0, "b", 1.0), (1, 2, 1, "a", 2.0), (1, 3, 2, "b", 3.0), (1, 4, 3, "a", 2.0)], "query_id int, rank int, ref int, label string, distance double")).first()
    assert voted["candidate"] == "a" and voted["vote_margin"] == 0


def test_scaler_of_a_constant_feature(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    s = neighbours.scaler(df).first()
    assert s["mean"] == [2.0, 5.0] and s["scale"] == [1.0, 1.0]
    assert neighbours.standardized(df, neighbours.scaler(df)).first()["v"] == [-1.0, 0.0]


def test_abstention_order_and_edges(spark):
    p = neighbours.Policy(1.0, 0.2, 5)
    rows = [(2.0, 1, 0.0, "distance"), (1.0, 4, 0.0, "class_count"), (1.0, 5, 0.2, "vote_margin"), (1.0, 5, 0.21, None)]
    df = spark.createDataFrame(rows, "d double, n int, m double, w string")
    assert all(r["g"] == r["w"] for r in df.select("w", neighbours.abstention(p, F.col("d"), F.col("n"), F.col("m")).alias("g")).collect())


def test_sweep_takes_ties_together(spark):
    df = spark.createDataFrame([(1.0, 0.6, True, True, True), (1.0, 0.6, True, False, False), (2.0, 0.4, True, True, False)], "nearest_distance double, vote_margin double, supported boolean, known boolean, correct boolean")
    got = {(r["margin"], r["distance"]): (r["known_accepted"], r["unknown_accepted"], r["correct_accepted"]) for r in evaluation.sweep(df).collect()}
    assert got[0.0, 1.0] == (1, 1, 1) and got[0.0, 2.0] == (2, 1, 1) and got[0.4, 1.0] == (1, 1, 1) and got[1.0, 0.0] == (0, 0, 0) and (0.4, 2.0) not in got


def test_text_measures_and_labels(spark):
    df = spark.createDataFrame([("déf Ünï_1 ...",), ("",), ("​� ab",)], "t string")
    got = df.select(text.measures(F.col("t")).alias("m")).select("m.*").collect()
    assert got[0]["words"] == 2 and got[0]["alphanumeric"] == 7 and got[1]["signals"] == ["text.empty"]
    assert got[2]["signals"] == ["text.too_short", "text.replacement_characters", "text.control_characters"]
    assert text.label_key("  Straße-A__b/ｃ ") == "strasse a b c"
    labels = spark.createDataFrame([("straße x",)], "t string").select(text.slug(F.col("t")).alias("s")).first()["s"]
    assert labels == "stra%C3%9Fe-x"
    noise = spark.createDataFrame([("\n\na\x00b  \r\nc\x0bd\n\n\n\n\ne\n",)], "t string").select(text.clean_noise(F.col("t")).alias("c")).first()["c"]
    assert noise == "ab\nc\nd\n\n\ne"


def plain_chunks(text, most, overlap):
    """The chunks of a text without titles, from the rules: all candidates are written down, and the best is taken."""
    import unicodedata

    n = len(text)
    mark = lambda i: unicodedata.category(text[i])[0] == "M" or "\U0001f3fb" <= text[i] <= "\U0001f3ff"
    cuts = [i for i in range(n + 1) if i in (0, n) or not (mark(i) or "\u200d" in text[i - 1 : i + 1])]
    at, out = 0, []
    while at < n:
        limit, end = min(n, at + most), n
        if limit < n:
            half = at + max((limit - at) // 2, 1)
            ends = [max((i + len(b) for i in range(half, limit - len(b) + 1) if text.startswith(b, i)), default=0) for b in documents.BREAKS]
            wish = next((e for e in ends if e), limit)
            end = max(c for c in cuts if c <= max(wish, at) or c == 0)
            end = end if end > at else min(c for c in cuts if c >= limit)
        first, last = at, end
        while first < last and text[first].isspace():
            first = min([c for c in cuts if c > first] + [last])
            first = min(first, last)
        while last > first and text[last - 1].isspace() and last - 1 in cuts:
            last -= 1
        if first < last:
            out.append((first, last))
        if end == n:
            return out
        at = min([c for c in cuts if c >= max(at + 1, end - overlap)] + [end])
        at = min(at, end)
        while at < end and text[at].isspace():
            at = min(min(c for c in cuts if c > at), end)
    return out


def test_chunks():
    import random

    body = "INTRO\n" + "word " * 700 + "\n# Next part\nshort. "
    found = [c[1:] for c in documents.chunked([body])]
    assert [f[1] for f in found][0] == "INTRO" and found[-1][1] == "Next part"
    for _, _, _, _, a, b, content in found:
        assert body[a:b] == content and 0 < b - a <= documents.MOST and not content[0].isspace() and not content[-1].isspace()
    covered = np.zeros(len(body), bool)
    for *_, a, b, _ in found:
        covered[a:b] = True
    assert all(c.isspace() for c, k in zip(body, covered, strict=True) if not k)
    titles = lambda t: [x[1] for x in documents.Texts([t]).headings()]
    assert titles("A FINE TITLE") == ["A FINE TITLE"] and titles("NO TITLE.") == [] and titles("## x y") == ["x y"] and titles("Mixed Case") == [] and titles("A " * 13) == [] and titles("#no") == []
    assert titles("x\rTOP\r\nlow\u2028## z ") == ["TOP", "z"]
    assert list(documents.chunked(["", "\n \n"])) == [] and list(documents.chunked([])) == []
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c .;\n\n  \te\u0301\u200d\U0001f600\U0001f3fbx; ") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for most, overlap in ((20, 5), (7, 3)):
        made = {}
        for i, *_, a, b, _ in documents.chunked(texts, most, overlap):
            made.setdefault(i, []).append((a, b))
        assert all(made.get(i, []) == plain_chunks(t, most, overlap) for i, t in enumerate(texts))


def test_secrets(spark):
    rows = {
        "see https://example.org/a and C:/x": [], "D:\\data": ["machine_path"], "c:/x": ["machine_path"], "/etc/x": ["machine_path"], "~/x": ["machine_path"], "\\\\host\\x": ["machine_path"],
        "at FILE://x": ["machine_path"], "in /Home/me": ["machine_path"], "a\\Users\\b": ["machine_path"], "https://me:pw@host": ["uri_credential"], "to https://me:pw@host": [], "password = x": ["assignment"], "ghp_0123456789": ["token"],
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.secrets(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == rows


def test_cleaned_spans(spark):
    import random

    rng = random.Random(4)
    texts = ["\n\na\x00b  \r\nc\x0bd\n\n\n\n\ne\n", "", " \t", "\r\n", "\x00", None] + ["".join(rng.choice("ab \t\r\n\n\x0b\x0c\x00\x7f\u00e9\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    spans = {r["k"]: r for r in documents.cleaned(df, "k", "t").collect()}
    for r in df.select("k", "t", text.clean_noise(F.col("t")).alias("c")).collect():
        got = spans[r["k"]]
        assert got["cleaned"] == r["c"]
        if r["t"] is not None:
            assert len(got["starts"]) == len(got["ends"]) == len(r["c"]) and all(a < b <= c for a, b, c in zip(got["starts"], got["ends"], [*got["starts"], len(r["t"])][1:], strict=True))
            for c, a, b in zip(r["c"], got["starts"], got["ends"], strict=True):
                assert r["t"][a:b] == c or (c == "\n" and r["t"][a:b] in ("\r\n", "\r", "\x0b", "\x0c"))


def test_hash_vector():
    v = text.hash_vector("abc", 8, "v1")
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-12 and v == text.hash_vector("abc", 8, "v1") != text.hash_vector("abc", 8, "v2")


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "cold motor"), (2, "hot motor"), (3, "cold cold night")], "d int, t string")
    tf = retrieval.terms(docs, "d", "t")
    weighted, idf = retrieval.weights(tf, "d", 3)
    found = {r["term"]: r["idf"] for r in idf.collect()}
    assert abs(found["cold"] - (math.log(4 / 3) + 1)) < 1e-12 and abs(found["cold motor"] - (math.log(4 / 2) + 1)) < 1e-12
    assert all(abs(r["p"] - 1) < 1e-12 for r in weighted.groupBy("d").agg(F.sum(F.col("weight") * F.col("weight")).alias("p")).collect())


def test_lifecycle_rules(spark):
    log = [("a", 1, None, "received", 1), ("a", 2, "received", "processing", 2), ("a", 3, "processing", "approved", 3), ("b", 1, None, "processing", 1), ("c", 1, None, "received", 5), ("c", 2, "received", "processing", 4), ("d", 1, None, "received", 1), ("d", 3, "received", "processing", 2), ("e", 1, None, "received", 1), ("e", 2, "failed", "processing", 2)]
    df = spark.createDataFrame(log, "k string, sequence long, source_status string, target_status string, occurred_at long")
    assert {(r["k"], r["sequence"]): r["problem"] for r in lifecycle.illegal(df, "k").collect()} == {("a", 3): "transition", ("b", 1): "first_event", ("c", 2): "clock", ("d", 3): "sequence", ("e", 2): "source_mismatch"}


_START = [(1, "registered", None, None, "received"), (1, "processing_started", None, "received", "processing")]
_READY = [*_START, (1, "step_succeeded", "extraction", "processing", "processing"), (1, "step_succeeded", "indexing", "processing", "pending_approval")]
_FAILED = [(1, "step_failed", "indexing", "processing", "failed"), (1, "reprocessing_started", None, "failed", "processing")]
_REJECTED = [*_READY, (1, "rejected", None, "pending_approval", "rejected"), (1, "reprocessing_started", None, "rejected", "processing")]
_APPROVED = [*_READY, (1, "approved", None, "pending_approval", "approved")]
_SECOND = [(2, *e[1:]) for e in _READY]
_SWITCH = [(1, "superseded", None, "approved", "superseded"), (2, "approved", None, "pending_approval", "approved")]
_HISTORIES = {
    "legal": ([*_APPROVED, *_SECOND, *_SWITCH], {}),
    "resumed": ([*_READY[:3], *_FAILED, _READY[3]], {}),
    "restarted": ([*_REJECTED, *_READY[2:]], {}),
    "first": ([_START[1]], {1: "first_event"}),
    "jump": ([*_APPROVED, (3, "registered", None, None, "received")], {6: "version_not_sequential"}),
    "content": ([*_APPROVED, (2, "registered", None, None, "received", "sha1")], {6: "content_already_registered"}),
    "repeat": ([*_START, _START[0]], {3: "repeated_registration"}),
    "conflict": ([*_START, (1, "registered", None, None, "received", "else")], {3: "version_conflict"}),
    "active": ([*_START, _SECOND[0]], {3: "active_candidate"}),
    "old": ([*_READY, (1, "rejected", None, "pending_approval", "rejected"), _SECOND[0], (1, "reprocessing_started", None, "rejected", "processing")], {7: "not_latest"}),
    "unknown": ([*_START, _SECOND[1]], {3: "unknown_version"}),
    "bytes": ([*_READY[:3], _FAILED[0], (1, "reprocessing_started", None, "failed", "processing", "else")], {5: "content_mismatch"}),
    "source": ([_START[0], _READY[2]], {2: "source_mismatch"}),
    "step": ([*_START, (1, "step_succeeded", "printing", "processing", "processing")], {3: "transition"}),
    "skip": ([*_START, _READY[3]], {3: "indexing_before_extraction"}),
    "fail_skip": ([*_START, _FAILED[0]], {3: "indexing_before_extraction"}),
    "twice": ([*_READY[:3], _READY[2]], {4: "step_already_succeeded"}),
    "kept": ([*_READY[:3], *_FAILED, _READY[2]], {6: "step_already_succeeded"}),
    "regress": ([*_READY[:3], (1, "step_failed", "extraction", "processing", "failed")], {4: "step_regressed"}),
    "restart": ([*_REJECTED, _READY[3]], {7: "indexing_before_extraction"}),
    "early": ([*_START, (1, "step_succeeded", "extraction", "processing", "pending_approval"), _APPROVED[-1]], {3: "completion", 4: "approval_blocked"}),
    "late": ([*_READY[:3], (1, "step_succeeded", "indexing", "processing", "processing")], {4: "completion"}),
    "two": ([*_APPROVED, *_SECOND, _SWITCH[1]], {10: "current_not_superseded"}),
    "alone": ([*_APPROVED, *_SECOND, _SWITCH[0]], {10: "supersession_alone"}),
}
_EVENT = "d string, version long, sequence long, action string, step string, sha256 string, actor string, source_status string, target_status string, occurred_at long"


def _events(spark, histories):
    return spark.createDataFrame([(d, e[0], i, e[1], e[2], e[5] if len(e) > 5 else f"sha{e[0]}", "x", e[3], e[4], 7) for d, log in histories.items() for i, e in enumerate(log, 1)], _EVENT)


def test_history_rules(spark):
    events = _events(spark, {d: log for d, (log, _) in _HISTORIES.items()})
    late = _events(spark, {"clock": _READY, "number": _READY})
    late = late.withColumn("occurred_at", F.expr("if(d = 'clock' and sequence = 3, 6, occurred_at)")).withColumn("sequence", F.expr("if(d = 'number' and sequence = 4, 5, sequence)"))
    got = {(r["d"], r["sequence"]): r["problem"] for r in lifecycle.history_problems(events.unionByName(late), "d").collect()}
    assert got == {(d, i): p for d, (_, found) in _HISTORIES.items() for i, p in found.items()} | {("clock", 3): "clock", ("number", 5): "sequence"}


def test_history_rules_of_the_query(spark, small):
    from oscilla.queries import corpus

    assert lifecycle.history_problems(corpus.governed_log(spark, small, False), "document").count() == 0
    found = {r["problem"] for r in corpus.governed_history_problems(spark, small).select("problem").distinct().collect()}
    assert found >= {"indexing_before_extraction", "step_already_succeeded", "step_regressed", "completion", "active_candidate", "current_not_superseded", "not_latest"}


def test_registering_again(spark):
    events = _events(spark, {"a": _APPROVED, "b": _START})
    commands = [("a", 1, "sha1", "x", 7, "unchanged"), ("a", 1, "sha1", "y", 7, "version_conflict"), ("a", 1, "sha9", "x", 7, "version_conflict"), ("a", 2, "sha1", "x", 7, "content_already_registered"), ("a", 3, "sha3", "x", 7, "version_not_sequential"), ("a", 2, "sha2", "x", 6, "clock"), ("a", 2, "sha2", "z", 7, "registered"), ("b", 2, "sha2", "x", 7, "active_candidate"), ("c", 1, "sha1", "x", 1, "registered")]
    df = spark.createDataFrame(commands, "d string, version long, sha256 string, actor string, occurred_at long, wanted string")
    got = sorted((r["d"], r["version"], r["sha256"], r["actor"], r["outcome"]) for r in lifecycle.registrations(events, df, "d").collect())
    assert got == sorted((d, v, s, a, w) for d, v, s, a, _, w in commands)


def test_swaps_keep_the_history(spark, small):
    from oscilla.queries import corpus

    wanted = {0: "applied", 1: "history_not_prefix", 2: "history_not_prefix", 3: "history_broken", 4: "state_not_replayed", 5: "conflict"}
    got = corpus.audited_swaps(spark, small).collect()
    assert {r["document"] % 6 for r in got} == set(wanted) and all(r["outcome"] == wanted[r["document"] % 6] for r in got)


def test_index_parity_reads_every_row(spark):
    """Rows 900 and on are far from the only query, so that no rank shows what befell them."""
    from oscilla.queries import models

    train = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in [*range(10), *range(900, 910)]], "ref long, label int, v array<double>")
    queries = spark.createDataFrame([(1, [0.4, 1.0])], "query_id long, v array<double>")
    found = lambda index: tuple(models.index_parity(train, index, queries).first())
    other = spark.createDataFrame([(950, 1, [950.0, 1.0])], train.schema)
    assert found(train) == (0, 0, 0)
    assert found(train.where("ref <> 905")) == (1, 0, 0)
    assert found(train.unionByName(other)) == (1, 0, 0)
    assert found(train.unionByName(train.where("ref = 907"))) == (1, 0, 0)
    assert found(train.withColumn("label", F.expr("if(ref = 903, 7, label)"))) == (0, 1, 0)
    bad = {901: "array(901.1D, 1D)", 902: "array(902D)", 904: "array(double('NaN'), 1D)", 906: "array(906D, null)", 908: "null"}
    for ref, value in bad.items():
        if ref not in (902, 906, 908):
            assert found(train.withColumn("v", F.expr(f"if(ref = {ref}, {value}, v)"))) == (0, 0, 1)
    stored = neighbours.stored_parity(train, train.withColumn("v", F.expr("case " + " ".join(f"when ref = {k} then {x}" for k, x in bad.items()) + " else v end")), "ref")
    assert tuple(stored.first()) == (0, 0, 5)


def test_outcomes(spark):
    rows = [("skipped", "normal", True, "normal"), ("skipped", "out_of_distribution", True, "out_of_distribution"), ("skipped", "no_evidence", True, "undocumented_fault"), ("generated", None, True, "documented_fault"), ("generated", None, False, "degraded"), ("degraded", "provider_busy", True, "degraded")]
    df = spark.createDataFrame(rows, "s string, r string, p boolean, w string").select("w", outcomes.outcome(F.col("s"), F.col("r"), F.col("p")).alias("o")).select("w", "o.*")
    assert all(r["w"] == r["outcome"] for r in df.collect())


def test_csv_and_manifest_and_publication(spark, tmp_path):
    df = reading(spark)
    path = str(tmp_path / "csv")
    df.coalesce(1).write.option("header", True).csv(path)
    assert sorted(map(tuple, readings.read_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))
    assert readings.read_csv_column(spark, path, "fault").distinct().count() == 1
    with pytest.raises(ValueError):
        readings.read_csv(spark, path, readings.SCHEMA.__class__(readings.SCHEMA.fields[::-1]))
    seen = [r for r in files.fingerprints(spark, path).collect() if r["path"].endswith(".csv")][0]
    name = seen["path"].split("/")[-1]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "algorithm": "sha256", "files": [{"name": name, "size_bytes": seen["length"], "sha256": "0" * 64}, {"name": "gone", "size_bytes": 1, "sha256": "1" * 64}]}))
    problems = {r["name"]: r["problem"] for r in files.audited(spark, path, str(tmp_path / "m.json")).collect()}
    assert problems[name] == "content" and problems["gone"] == "missing"
    out = str(tmp_path / "published")
    assert files.publish(spark, {"canonical": df}, out, "d1") and not files.publish(spark, {"canonical": df}, out, "d1")
    with pytest.raises(FileExistsError):
        files.publish(spark, {"canonical": df}, out, "d2")
    assert files.checked_parquet(spark, f"{out}/canonical", readings.SCHEMA).count() == 3
    assert "| 3 |" in files.render(profile.volume(df).select("row_count"), "Volume")


def test_strict_json():
    assert [files.strict_object(t) for t in ('{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "{", None)] == [None, "duplicate_key", "not_finite", "root", "syntax", "missing"]


def test_upsert_refuses_another_content(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert documents.upsert(a, spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"]).count() == 2
    with pytest.raises(Exception, match="differs"):
        documents.upsert(a, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"]).collect()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.euclidean(F.col("a"), F.col("b")).alias("d"), vectors.cosine_score(F.col("a"), F.col("b")).alias("c"), vectors.from_literal(vectors.literal(F.col("a"))).alias("l")).first()
    assert r["d"] == 5.0 and r["c"] is None and r["l"] == [3.0, 4.0]


def test_stream_scoring_matches_batch(spark, tmp_path):
    train = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(20)], "ref long, label int, v array<double>")
    queries = spark.createDataFrame([(i, [i + 0.4, 1.0]) for i in range(5)], "query_id long, v array<double>")
    queries.write.parquet(str(tmp_path / "q"))
    stream = streams.source(spark, str(tmp_path / "q"), queries.schema)
    streams.score(stream, train, str(tmp_path / "out"), 2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "ref").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, neighbours.ranked(queries, train, 2).select("query_id", "rank", "ref").collect()))


@pytest.mark.parametrize("own", [False, True])
def test_nearest_against_brute_force(spark, own):
    """More than one block a side, ties, and fewer rows than k."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (300, 5)).astype(float)
    q = x[:40]
    train = spark.createDataFrame([(i, f"l{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(999, "none", None)], "ref long, label string, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, v array<double>")
    found = neighbours.ranked(asked, train, 7, exclude_self=own).orderBy("query_id", "rank").collect()
    wanted = []
    for i, v in enumerate(q):
        d = [(float(np.sqrt(((x[j] - v) ** 2).sum())), j) for j in range(300) if not (own and i == j)]
        wanted += [(i, r, j, f"l{j % 3}", e) for r, (e, j) in enumerate(sorted(d)[:7], 1)]
    assert [tuple(r) for r in found] == wanted
    few = neighbours.ranked(asked.limit(2), train.where("ref < 3"), 7).collect()
    assert len(few) == 6 and neighbours.ranked(asked.limit(0), train).count() == 0


def test_exact_quantiles_inside_brackets(spark, monkeypatch):
    """The bracketed way, forced on a small table by narrow limits, against numpy on ties, few values, nulls and NaN."""
    monkeypatch.setattr(quantiles, "SMALL", 100)
    monkeypatch.setattr(quantiles, "SLACK", 0.01)
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(3001)) / 7).alias("a"), F.pmod("id", F.lit(3)).cast("double").alias("b"), F.when(F.col("id") < 60, F.col("id").cast("double")).otherwise(float("nan")).alias("c"), F.lit(None).cast("double").alias("d"))
    local, qs = df.toPandas(), (0.0, 0.25, 0.5, 0.95, 1.0)
    found = {r["column_name"]: r for r in quantiles.interpolated(df, {c: F.col(c) for c in df.columns}, qs).collect()}
    for c in "abc":
        x = local[c].dropna()
        assert found[c]["n"] == len(x) and np.allclose(found[c]["values"], np.quantile(x, qs), atol=1e-9)
    assert found["d"]["n"] == 0 and found["d"]["values"] == [None] * 5


def test_quantiles_are_exact_whatever_the_sketch_says(spark, monkeypatch):
    """A sketch of three accuracy steps misses its brackets by far; the counts tell, and wider ones find the elements."""
    monkeypatch.setattr(quantiles, "SMALL", 10)
    monkeypatch.setattr(quantiles, "SLACK", 1e-4)
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    df, qs = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("a"), F.pmod("id", F.lit(2)).cast("double").alias("b")), (0.0, 0.31, 0.5, 0.95, 1.0)
    rows = df.select(F.col("a").alias("x0"), F.col("b").alias("x1"))
    assert not all(b.holds() for b in quantiles._bracketed(rows, range(2), qs, quantiles.SLACK))
    found, local = {r["column_name"]: r for r in quantiles.interpolated(df, {c: F.col(c) for c in df.columns}, qs).collect()}, df.toPandas()
    for c in "ab":
        assert found[c]["n"] == 4000 and np.allclose(found[c]["values"], np.quantile(local[c], qs), atol=1e-9)


def test_input_order_across_stretches(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(40)], "p long, at long")
    order = lambda d: profile.input_order(d, F.col("at"), F.col("p"), 8).first()[0]
    assert order(df) == "nondecreasing" and order(df.withColumn("at", -F.col("at"))) == "nonincreasing"
    assert order(df.withColumn("at", F.lit(1))) == order(df.limit(0)) == "constant"
    assert order(df.withColumn("at", F.when(F.col("p") == 16, 0).otherwise(F.col("at")))) == "unordered"


def test_only_changed_reports_are_written(spark, tmp_path):
    path = str(tmp_path / "extraction")
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "document string, pages int, note string")
    assert files.write_changed(df, path, "document") == 2 and files.write_changed(df, path, "document") == 0
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "extraction" / "key=a").iterdir()}
    assert files.write_changed(df.withColumn("pages", F.col("pages") + F.when(F.col("document") == "b", 1).otherwise(0)), path, "document") == 1
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "extraction" / "key=a").iterdir()}
    stored = {r["key"]: json.loads(r["value"]) for r in spark.read.text(path).collect()}
    assert stored == {"a": {"document": "a", "note": None, "pages": 1}, "b": {"document": "b", "note": "x", "pages": 3}}
    with pytest.raises(ValueError, match="report"):
        files.write_changed(df, path, "document", most=1)


def test_sentinels_and_strict_outputs(spark):
    from oscilla.functions.strict_json import canonical_json
    from oscilla.operators import generation

    name, stem = "doc-1", f"UNTRUSTED_DOCUMENT_{__import__('hashlib').sha256(b'doc-1').hexdigest()}"
    rows = [("", 0), (f"{stem}_1_BEGIN", 0), (f"x{stem}_0_END{stem}_1_BEGIN", 2), (f"{stem}_00_END", 0), (f"{stem}_0_BEGIN" * 3, 1)]
    found = generation.enveloped(spark.createDataFrame([(name, c, n) for c, n in rows], "evidence_id string, content string, n int")).collect()
    assert all(r["begin_sentinel"] == f"{stem}_{r['n']}_BEGIN" and r["begin_sentinel"] not in r["content"] and r["end_sentinel"] not in r["content"] for r in found)
    texts = ['{"b":1,"a":[{"d":null,"c":"é"}]}', '{"a":1,"a":1}', "{} {}", "", None, '{"a":NaN}', '["Infinity"]', "[1e999]"]
    made = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t"))).collect()]
    assert made == ['{"a":[{"c":"é","d":null}],"b":1}', None, None, None, None, None, '["Infinity"]', None]


def test_threshold_by_brackets_equals_one_buffer(spark, monkeypatch):
    """Few gaps are fitted in one buffer, many by brackets: the same number."""
    steps = [(7 * i * i) % 101 for i in range(400)]
    rows = spark.createDataFrame([(sum(steps[: i + 1]) * 1_000, i) for i in range(400)], "at long, position long")
    plain = split.fit_threshold(rows)
    gaps = sorted(1_000 * s for s in steps[1:] if s)
    at = lambda q: gaps[math.floor((len(gaps) - 1) * q)] + ((len(gaps) - 1) * q % 1) * (gaps[math.ceil((len(gaps) - 1) * q)] - gaps[math.floor((len(gaps) - 1) * q)])
    assert abs(plain - max(5 * at(0.5), at(0.95))) < 1e-6
    monkeypatch.setattr(quantiles, "SMALL", 0)
    assert split.fit_threshold(rows) == plain
