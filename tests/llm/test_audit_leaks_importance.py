"""Filter audit, benchmark decontamination and importance resampling by brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

import __spark_entry__ as entry
from narrowmat.llm import decontamination, filter_audit, importance
from oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, n_words int, __row string, part string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def _rows():
    rng = np.random.default_rng(11)
    common = [f"w{k}" for k in range(60)] + ["Été", "naïve", "日本", "x1", "İ"]
    say = lambda n: " ".join(rng.choice(common, n))
    texts = [None, "", " \t\x0b\n", "!!! ...", "one", "A B C", "#", say(49), say(50), say(51).upper(), say(4000) + "\x00end"]
    texts += [say(int(n)) for n in rng.integers(1, 90, 40)]
    texts += [texts[12], texts[12], texts[20], None, " ".join(f"u{k}" for k in range(80)), " ".join(f"u{k}" for k in range(80))]
    rows = [(k, t, [None, "", "a", "b", "c"][k % 5]) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (12, "another text", "b"), (None, texts[20], "a"), (None, None, None), (-5, texts[30], "c")]
    return rows


ROWS = _rows()
ITEMS = [
    (3, " ".join(ROWS[13][1].split()[:10])), (10, ROWS[10][1][:400]), (2, "w3, W4!"), (2, "naïve"), (7, None), (8, "..."),
    (None, ROWS[14][1]), (11, "日本 x1 日本 x1"), (3, " ".join(ROWS[13][1].split()[:10])), (12, "never seen anywhere"),
]
LABELS = [(k, k % 2, (k // 2) % 2) for k in range(0, 60, 3)] + [(12, 0, 0), (12, 1, None), (None, 1, 1), (500, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "other", 1, "x", "y") for i, t, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, words string").repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def _words(text):
    return WORDS.findall((text or "").translate(FOLD))


def _audit():
    texts = [(i, t or "", s or "") for i, t, s in ROWS]
    marks = []
    for i, t, part in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        }
        good = i is not None and any(d == i and q == 1 for d, q, _ in LABELS)
        toxic = i is not None and any(d == i and x == 1 for d, _, x in LABELS)
        marks.append((part, fails, good, toxic))
    out, removed = {}, defaultdict(int)
    for part in {m[0] for m in marks}:
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in marks if m[0] == part]
            whole = left
            for step, f in enumerate(order, 1):
                gone = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                removed[part, f] += len(gone)
                only = sum(1 for m in whole if m[1][f] and sum(m[1].values()) == 1)
                all_fail = sum(1 for m in whole if m[1][f])
                out[part, order, step] = (len(left), len(gone), all_fail - len(gone), only, sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(rows) == len(found) and found == _audit()
    nothing = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(nothing, labels).collect() == []
    without = filter_audit.audit(docs, labels.limit(0)).groupBy().sum("good_lost", "toxic_lost", "removed").first()
    assert without[0] == without[1] == 0 and without[2] > 0


def _hits(text):
    words, spans, ids = _words(text), set(), set()
    for i, t in ITEMS:
        w = _words(t)
        k = min(10, len(w))
        if not k:
            continue
        own = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
        at = [a for a in range(len(words) - k + 1) if tuple(words[a : a + k]) in own]
        if at and i is not None:
            ids.add(str(i))
        spans |= {p for a in at for p in range(a, a + k)}
    return words, spans, sorted(ids)


def _leaks(row):
    words, spans, ids = _hits(row[1])
    return row[0], len(words), len(spans), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(spans)


@pytest.mark.parametrize("broadcast, bits", [(1 << 18, (1 << 14, 1 << 23)), (0, (64, 64))])
def test_decontamination(spark, docs, items, monkeypatch, broadcast, bits):
    # Also where nothing is broadcast and the bits are so few that all are set.
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontamination, "LEAST_BITS", bits[0])
    monkeypatch.setattr(decontamination, "MOST_BITS", bits[1])
    found = decontamination.contamination(docs, items)
    wanted = Counter(map(_leaks, ROWS))
    assert Counter(map(tuple, found.collect())) == wanted
    assert 5 < sum(n for k, n in wanted.items() if k[-1]) < len(ROWS)


def test_decontamination_has_no_python_and_no_cross_join(docs, items):
    plan = decontamination.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|NestedLoop|Cartesian", plan.split("InMemoryRelation")[0])


def test_decontamination_of_empty_tables(spark, docs, items):
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    clean = decontamination.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


def test_decontaminated(docs, items):
    whole = decontamination.decontaminated(docs, items)
    assert whole.columns == docs.columns and whole.schema == docs.schema
    assert Counter((r[0], r[1]) for r in whole.collect()) == Counter((i, t) for i, t, _ in ROWS if not _leaks((i, t))[-1])
    cut = decontamination.decontaminated(docs, items, remove="spans")
    assert cut.columns == docs.columns

    def without(text):
        words, spans, _ = _hits(text)
        if not spans:
            return text
        found = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
        assert len(found) == len(words)
        return "".join(p for k, p in enumerate(found) if k not in spans) + text[sum(map(len, found)) :]

    assert Counter((r[0], r[1]) for r in cut.collect()) == Counter((i, without(t)) for i, t, _ in ROWS)
    with pytest.raises(ValueError):
        decontamination.decontaminated(docs, items, remove="words")


def _features(text):
    w = _words(text)
    return w, [x.encode() for x in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:])]


def _draw(rows, target, share=25, least=20):
    count = lambda texts: Counter(zlib.crc32(f) % 10000 for t in texts for f in _features(t)[1])
    s, t = count(r[1] for r in rows), count(target)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    scored = []
    for i, text, _ in rows:
        w, f = _features(text)
        weight = sum(gain(zlib.crc32(x) % 10000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [(*x[:4], r) for r, x in enumerate(able[: share * len(able) // 100], 1)]
    rest = [(*x[:4], None) for x in scored if x[4] < least] + [(*x[:4], None) for x in able[len(drawn) :]]
    return Counter(drawn + rest)


@pytest.mark.parametrize("run_bytes", [1 << 21, 100])
def test_importance(docs, items, monkeypatch, run_bytes):
    monkeypatch.setattr(importance, "RUN_BYTES", run_bytes)
    found = importance.resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, found)) == _draw(ROWS, [t for _, t in ITEMS])


def test_importance_of_empty_tables(docs, items):
    assert importance.resample(docs.limit(0), items).collect() == []
    found = importance.resample(docs, items.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, found)) == _draw(ROWS, [])
    kept = importance.resampled(docs, items)
    assert kept.columns == docs.columns
    drawn = {k[0] for k in _draw(ROWS, [t for _, t in ITEMS]) if k[4]}
    assert {r[0] for r in kept.collect()} == drawn - {None}


def test_joined_checksums():
    rng = np.random.default_rng(0)
    parts = [(rng.bytes(a), rng.bytes(b)) for a, b in rng.integers(0, 70, (200, 2))]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1))
    lengths = np.array([len(p[1]) for p in parts])
    assert importance.joined_crc(first, second, lengths).tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_decontamination"])
def test_sql(spark, sf, name):
    difference, _ = compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert difference is None


def test_importance_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = entry.queries()["op13_importance"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found) == _draw(rows, target)
