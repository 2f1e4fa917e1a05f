"""Ranking by cosine in blocks: against plain Python, over several blocks, buckets and groups of questions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from oscilla.operators import cosine

WORDS = ["motor", "cold", "é1", "ab", "_x", "naïve", "Ölz", "hot", "zz9", "night", "a"]


def terms(text):
    plain = str.maketrans("éïö", "eio")
    w = re.findall(r"\w{2,}", (text or "").lower().translate(plain))
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w[:-1], w[1:]))])


def wanted(questions, docs, k):
    corpus = {}
    for key, text in docs:
        corpus.setdefault(key, Counter()).update(terms(text))
    df = Counter(t for c in corpus.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    unit = lambda c: {t: n * idf[t] for t, n in c.items() if t in idf}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for q, text in questions:
        a = unit(terms(text))
        found = [(round(sum(x * b[t] for t, x in a.items() if t in b) / length(a) / length(b), 9), d) for d, b in ((d, unit(c)) for d, c in corpus.items()) if a.keys() & b.keys()]
        out += [(q, d, s, i) for i, (s, d) in enumerate(sorted(found, key=lambda r: (-r[0], r[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, questions, products", [(1 << 22, 1 << 10, 1 << 21), (700, 3, 50)])
def test_against_plain_python(spark, monkeypatch, block, questions, products):
    for name, value in (("BLOCK", block), ("QUESTIONS", questions), ("PRODUCTS", products)):
        monkeypatch.setattr(cosine, name, value)
    rng = random.Random(5)
    text = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randrange(most)))
    docs = [(d, text(30)) for d in range(120)] + [(d, "cold motor cold night") for d in range(200, 230)] + [(300, None), (301, ""), (302, "a ? b"), (5, "hot zz9")]
    asked = [(q, text(12)) for q in range(10)] + [(10, "unseen words"), (11, None), (12, "cold motor")]
    found = cosine.best(spark.createDataFrame(asked, "q int, t string"), spark.createDataFrame(docs, "d long, t string"), "q", "d", "t", 3)
    got = sorted((r["q"], r["d"], r["score"], r["rank"]) for r in found.select("q", "d", "score", "rank").collect())
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in wanted(asked, docs, 3)]
    assert all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(got, wanted(asked, docs, 3), strict=True))


def test_only_vocabulary_and_best_rows_move(spark):
    """No exchange of the plan carries a row for each term of a document, or for each pair of a question and a document."""
    docs = spark.range(300).selectExpr("id as d", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', (id * i) % 40))) as t")
    asked = spark.range(20).selectExpr("id as q", "concat('w', id, ' w', id + 1) as t")
    found = cosine.best(asked, docs, "q", "d", "t", 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 40 and "Join" not in plan and "Generate explode(words" not in plan
