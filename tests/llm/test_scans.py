"""Private data, secrets and the two classifiers."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from lumenreel.llm import pii, quality, secrets, toxicity
from tests.conftest import SMALL


def plain_private(t):
    digits = lambda s: re.sub(r"\D", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def plain_secrets(t):
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@pytest.mark.parametrize(
    ("parts", "ours", "plain"),
    [
        ([*"ab.@-12+ ()é", "12.3.4.5", "+1 (377) 555-0271", "4111111111111111", "a@b.c"], pii.base_spans, plain_private),
        ([*"a0f =:\"'Z9ſK", "AKIA", "token", "Api_Key", "PASSWD", "0123456789abcdef"], secrets.base_spans, plain_secrets),
    ],
)
def test_base_spans(parts, ours, plain):
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert ours(t) == plain(t), t


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")


def test_private_data(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    w = pii.train(docs)
    texts = [None, "", "a" * 200_000, "1" * 5000, "@" * 5000, "call +1 (377) 555-0271, again (377) 555-0271", "in 2024 there were 12 of 300 at 10:30, v1.2.3", "x@y.example.com x@y.example.com"]
    df = rows(spark, texts + texts[:2])
    got = {r.doc_id: r for r in pii.find_private(df, w).collect()}
    assert len(got) == len(texts) + 2
    for i, t in enumerate(texts):
        base = [f"{k}:{a}:{b}" for k, a, b in plain_private(t or "")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(",")) | {""}
    assert got[6].spans == "" and got[7].n_email == 2
    more = [s for s in got[5].spans.split(",") if s.startswith("phone")]
    assert len(more) == 2
    assert pii.find_private(df.limit(0), w).count() == 0 and pii.find_private(df.limit(0)).count() == 0


def test_skip_edges_carry_labels():
    """A word without evidence of its own takes the label of its certain twin, one without a twin doesn't."""
    graph = pii.Graph(["+49 30 1234567 then 1234567 and 7654321"])
    w = pii.fit(graph, np.zeros(len(graph.slots), int), rounds=0)
    known = graph.labels([[("phone", 0, 14)]])
    p = pii.marginals(graph, w, known)
    words = ["+49 30 1234567 then 1234567 and 7654321"[a:b] for a, b in zip(graph.start, graph.end, strict=True)]
    assert p[len(words) - 2 if words[-1] == "7654321" else -1, 4] > 0.8 and abs(p[words.index("7654321"), 4] - 0.2) < 0.05


def test_ledger_scans_only_unseen(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    old = rows(spark, ["token = abcdef1234", "clean", "clean", None])
    assert secrets.update_ledger(old.limit(0), path)[1] == 0
    assert secrets.update_ledger(old, path)[1] == 3
    assert secrets.update_ledger(old, path)[1] == 0  # a second run scans nothing
    new = rows(spark, ["clean", "AKIA" + "Z" * 16, "token = abcdef1234"])
    assert secrets.update_ledger(new, path)[1] == 1
    assert secrets.read_ledger(spark, path).count() == 4
    assert secrets.update_ledger(new, path, "2")[1] == 3
    got = {r.doc_id: (r.n_assign, r.n_access, r.spans) for r in secrets.scan_documents(new, path).collect()}
    assert got == {0: (0, 0, ""), 1: (0, 1, "access:0:20"), 2: (1, 0, "assign:0:18")}
    assert secrets.scan_documents(old.limit(0)).count() == 0


def test_ledger_with_versions_and_repeated_pairs(spark, tmp_path):
    """Versions of a document are blobs of their own; pairs that two runs appended count once."""
    path, twin = f"file://{tmp_path}/ledger", f"file://{tmp_path}/twin"
    docs = spark.createDataFrame([(1, "first token=abcdef99"), (1, "second, clean"), (2, "second, clean"), (None, "first token=abcdef99")], "doc_id long, text string")
    assert secrets.update_ledger(docs, path)[1] == 2 == secrets.update_ledger(docs, twin)[1]
    secrets.read_ledger(spark, twin).write.mode("append").parquet(path)
    got = sorted(((r.doc_id or 0), r.n_assign) for r in secrets.scan_documents(docs, path).collect())
    assert got == [(0, 1), (1, 0), (1, 1), (2, 0)]


def test_long_secrets_are_whole():
    """Nothing is cut: long passwords, hosts and labels are in the span to their end."""
    word = "p" * 5_000
    text = f"see https+x://user:{word}@{'h' * 3_000}.org/x and 9://no and ://u:pass@h"
    found = secrets.all_spans(text, secrets.base_spans(text))
    assert found == [("address", 4, text.index("/x and"))]
    key = "-----BEGIN " + "A " * 40 + "PRIVATE KEY-----" + "Q" * 9_000 + "-----END " + "A " * 40 + "PRIVATE KEY-----"
    assert ("pem", 2, 2 + len(key)) in secrets.all_spans("a " + key + " b", [])
    many = "token: abcdef%d; " * 1
    long = "".join(many % i for i in range(20_000))
    assert len(secrets.base_spans(long)) == 20_000 and secrets.masked(long, ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.base_spans(long)), "#") == "#; " * 20_000


def test_masking_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a token = 0123456789abcdef01234567 b", "s", 7), (2, None, "s", None), (3, "clean", "s", 5)], "doc_id long, text string, blob string, n_chars long")
    got = {r.doc_id: tuple(r) for r in secrets.masked_documents(df).collect()}
    assert got == {1: (1, "a [secret] b", "s", 12), 2: (2, None, "s", None), 3: (3, "clean", "s", 5)}


@pytest.fixture(scope="module")
def labelled(spark):
    """The small tables have few labels, so the larger ones are used."""
    path = SMALL.replace("0.001", "0.1")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def accuracy(scored, labels, column):
    r = scored.where("held_out").join(labels, "doc_id").where(f"{column} is not null").select("predicted", column).toPandas()
    return (r["predicted"] == r[column]).mean(), len(r)


def test_quality(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    share, n = accuracy(quality.score_documents(docs, model), labels, "quality")
    assert n > 500 and share > 0.97


def test_toxicity(labelled):
    docs, labels = labelled
    share, n = accuracy(toxicity.score_documents(docs, toxicity.train(docs, labels)), labels, "toxic")
    assert n > 500 and share > 0.97


def test_factor_identity():
    """The linear-time score equals the sum over all pairs."""
    m = quality.FactorisationMachine()
    m.w[:] = np.random.default_rng(1).normal(size=len(m.w))
    texts = ["some words and some more", "A line.\nAnother %%% line", ""]
    of, slot, value, stats = quality.features(texts)
    for t in range(3):
        s = [(k, float(v)) for k, v in zip(slot[of == t], value[of == t], strict=True)] + [(quality.SLOTS + k, float(v)) for k, v in enumerate(stats[t])]
        want = m.bias + sum(m.w[k] * v for k, v in s) + sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(s) for b, y in s[:i])
        assert abs(m.raw(of, slot, value, stats)[t] - want) < 1e-3


def test_trees_equal_a_plain_version():
    """Splits by trying every bin of every feature, and scores by walking each tree, one row at a time."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 0.4] = 1
    model = toxicity.BoostedTrees(trees=6, bins=8).fit(x, y, x, y)
    bins = [[sum(e < v for e in model.edges[k]) for k, v in enumerate(row)] for row in x.tolist()]
    raw = [model.base] * len(x)
    for feature, cut, value in model.trees:
        g = [1 / (1 + np.exp(-r)) - t for r, t in zip(raw, y, strict=True)]
        h = [p * (1 - p) for p in (1 / (1 + np.exp(-r)) for r in raw)]

        def gain(left, g=g, h=h):
            part = lambda own: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + model.ridge)
            return part([i for i in range(len(x)) if left[i]]) + part([i for i in range(len(x)) if not left[i]]) - part(range(len(x)))

        def enough(left, h=h):
            return min(sum(h[i] for i in range(len(x)) if left[i]), sum(h[i] for i in range(len(x)) if not left[i])) >= model.least / 4

        tried = [[b[k] <= c for b in bins] for k in range(4) for c in range(9)]
        best = max(gain(left) for left in tried if enough(left))
        assert abs(gain([b[feature[0]] <= cut[0] for b in bins]) - best) < 1e-6
        for i, b in enumerate(bins):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + (b[feature[node]] > cut[node])
            raw[i] += value[node - (2**model.depth - 1)]
    assert np.allclose(raw, model.raw(x)) and np.allclose(model.score(x), np.interp(raw, model.at, model.value))


def test_isotonic():
    at, value = toxicity.isotonic(np.array([3.0, 1, 2, 4, 2]), np.array([0.0, 0, 1, 1, 1]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()


def test_classifiers_on_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "x" * 100_000, 7), (3, "x", 8)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        q, t = quality.train(df, labels), toxicity.train(df, labels)
        for scored in (quality.score_documents(df, q), toxicity.score_documents(df, t)):
            got = scored.collect()
            assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert quality.kept_documents(df, q).columns == df.columns and toxicity.clean_documents(df, t).columns == df.columns
        assert quality.score_documents(df.limit(0), q).count() == 0
