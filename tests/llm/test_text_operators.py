"""The text operators against brute force, on a small table with every odd case."""

import hashlib
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narrowmat.llm import bpe, exact_dedup, language, licenses, lm, mixing, near_dedup, neighbours, rans, warc
from narrowmat.llm.components import components
from narrowmat.llm.pretokens import classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string"


def _rows():
    rng = np.random.default_rng(3)
    say = lambda words, n: " ".join(rng.choice(words, n))
    english, french = "the of and to river stone walked under".split(), "le de été où forêt marché être sous".split()
    long = say([f"w{k}" for k in range(300)], 4000)
    edited = long.split()
    edited[7] = "changed"
    rows = [(None, "no id here", "en", "a"), (1, None, "en", None), (2, "", None, "b"), (3, " \t\n", "fr", "b"), (4, "!!! 123", "en", "b"), (5, long, "en", "a"), (6, " ".join(edited), "en", "a"), (7, long.upper(), "en", "c"), (7, long.upper(), "en", "c"), (8, long, "en", None), (9, "Don't <|endoftext|> 's  x", "en", "c")]
    rows += [(k, say(english, 30), "en", "a") for k in range(10, 40)] + [(k, say(french, 30), "fr", "b") for k in range(40, 70)]
    rows += [(70, "SPDX-License-Identifier: (MIT OR GPL-2.0+) AND Apache-2.0 WITH exception", "en", "c"), (71, "CC BY. All Rights\nReserved, all rights reserved", "en", "c")]
    return [(i, t, lang, s, len(t or ""), "other") for i, t, lang, s in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, nothing):
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(found) == len({r[0] for r in ROWS})
    for k in (1, 2, 3, 4):
        assert found[k].lang_pred == "und" and found[k].score == 0
    assert all(found[k].lang_pred == ("en" if k < 40 else "fr") for k in range(10, 70))
    assert all(found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in found if k is not None)
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()}.isdisjoint({1, 2, 3, 4})
    assert language.identify(nothing).count() == 0


def test_warc(spark):
    big = "<p>" + "é" * 1200
    rows = [(1, "http://www.A.org:80/x", big), (2, "https://b.a.org/", big), (2, "https://b.a.org/", big), (3, None, None), (None, "http://a.org/x", big), (4, "x\r\ny", "small\r\n\r\nWARC/1.1\r\n\r\n"), (5, "x", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.captures(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next((h for i, _, h in rows if i == r.page_id), None) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        again = r.page_id in (1, None)
        assert (r.record_type, r.refers_to) == (("revisit", 2) if again else ("response", None))
    keys = [(r.urlkey, r.ts) for r in found]
    assert keys == sorted(keys) and keys[0][0] == ")"
    assert warc.captures(pages.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def _ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_rans(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start, wanted = Tokenizer.from_file(path), 0, Counter()
    for i, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = _ids(library, text)
        wanted[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    found = rans.write_and_read(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert Counter(tuple(r) for r in found) == wanted
    assert rans.write_and_read(nothing, path).count() == 0


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 63, 5000, 200_000):
        ids = rng.geometric(0.01, n) % 3000
        table = rans.Table(np.bincount(ids, minlength=3000))
        data = rans.encode_block(ids, table)
        assert (rans.decode_block(data, table) == ids).all()
        assert (rans.decode_block(data, table, n // 2, n // 2 + 99) == ids[n // 2 : n // 2 + 99]).all()
        with pytest.raises(ValueError):
            rans.decode_block(data[:-1] + bytes([data[-1] ^ 1]), table)
    a, b = rng.bytes(1000), rng.bytes(333)
    assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), 333) == zlib.crc32(a + b)


KINDS = classes()
BYTE = rans.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), KINDS)
TEXT = st.text(alphabet=st.sampled_from("ab Z's't've'll 19½é\n\t 　ß漢,.-!<|>İΣ"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_byte_pieces(text):
    assert BYTE.ids([text, text])[0].tolist() == 2 * _ids(BYTE.library, text).tolist()


def test_bpe(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for words in (20, 1 << 16):
        for r in bpe.encode(docs, path, words=words, texts=True).collect():
            texts = [row[1] or "" for row in ROWS if row[0] == r.doc_id]
            ids = library.encode(texts[0], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids == " ".join(map(str, ids))
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest()
    assert bpe.encode(nothing, path).count() == 0


def test_long_words_merge_as_short_ones_do(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    merger, library = bpe.Merger(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    for k in range(300):
        letters = ["ab", "the", "aàéß", "abcdefghijklmnopqrstuvwxyz", "日本語"][k % 5]
        symbols = [merger.letters[b] for b in "".join(rng.choice(list(letters), int(rng.integers(1, 90)))).encode()]
        symbols[-1] += bpe.END
        assert merger._short(list(symbols)) == merger._long(list(symbols))
    rows = [(k, "".join(rng.choice(list("etaoinshrdluETAOéø"), n))) for k, n in enumerate((47, 48, 49, 5000, 60_000))]
    rows += [(9, "x " + "ab" * 20_000 + " <|endoftext|>" * 3 + "!" * 3000)]
    found = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, texts=True).collect()
    for r in found:
        ids = library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.decoded == library.decode(ids, skip_special_tokens=False)
    began = time.process_time()
    merger.ids("".join(rng.choice(list("etaoinshrdlu"), 1_000_000)))
    assert time.process_time() - began < 60


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=30), st.lists(st.binary(min_size=1, max_size=6), max_size=20))
def test_lexicon(entries, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    asked = [*entries, *others]
    assert lexicon.find(asked) == [entries.get(w) for w in asked]


def _shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _components(rows):
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) * 100 >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    ids = [[rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None] for r in root]
    return Counter((r[0], len(s), min(i, default=None)) for r, s, i in zip(rows, sets, ids))


def test_near(docs, nothing):
    found = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(ROWS)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_near_long_lists(spark):
    """Chains of edits: lists longer than a pivot reaches, several components."""
    rng = np.random.default_rng(1)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(90):
        words = list(base)
        for j in range(k // 12):
            words[10 * j + int(rng.integers(0, 9))] = f"x{k}-{j}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, short=4, block=8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == _components(rows)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60) if k % 20 != 19] + [(5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: k // 20 * 20 for k in range(60)}


def test_mixing(docs, nothing):
    table = docs.toDF(*docs.columns[:-1], "taken")  # replaced
    found = mixing.mix(table).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert r.size == len((r.text or "").encode().split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
    sizes = Counter()
    for r in found:
        sizes[r.source] += r.size
    goal = mixing.targets(sizes)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values())) or any(goal[s] == 3 * sizes[s] for s in goal)
    for s in sizes:
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) for r in found if r.source == s)
    again = mixing.mix(table.repartition(5)).collect()
    key = lambda rows: Counter((r.doc_id, r.taken) for r in rows)
    assert key(found) == key(again)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(nothing).count() == 0


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(1, 400)), f"s{k % 4}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t / r.g - 1) < 0.002 for r in sums)


def test_exact(docs, nothing):
    found = exact_dedup.exact_duplicates(docs, block_bytes=16).collect()
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(text or "", []).append(i)
    wanted = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            wanted[i, keep, len(ids), i == keep and i not in ids[:k], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == wanted
    kept = exact_dedup.keep_one(docs, block_bytes=16)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_licenses(docs, nothing):
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = found[71]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (8, 3, 0, 5, "cc-by,reserved")
    assert found[70].labels == "apache-2.0,gpl-2.0+,mit" and found[70].permissive and found[70].score == 1
    assert (found[1].n_words, found[1].first_word, found[1].labels) == (0, None, "")
    assert licenses.scan(nothing).count() == 0


def test_expressions():
    assert licenses.evaluate(licenses.postfix("mit and (gpl-3.0 or isc)"), {"mit", "isc"}) == ({"mit", "gpl-3.0", "isc"}, True)
    assert licenses.evaluate(licenses.postfix("mit or gpl-3.0 and agpl"), {"mit"})[1]
    assert not licenses.evaluate(licenses.postfix("(mit or gpl-3.0) and agpl"), {"mit"})[1]
    for bad in ("", "and mit", "(mit", "mit or"):
        with pytest.raises(licenses.BadExpression):
            licenses.postfix(bad)


def test_lm(docs, nothing):
    found = lm.score(docs, frequent=5).collect()
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in ROWS]
    learned = [w for i, w in words if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(x for w in learned for x in w)
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    value = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    wanted = sorted((len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(value(counts[x]) for x in w) + value(len(learned)), 6)) for _, w in words)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == wanted
    assert all(r.train_tokens == n and r.score < 0 for r in found)
    held = [r for r in found if r.doc_id is not None and 10 <= r.doc_id < 70 and r.held_out]
    assert held and all(r.bits_per_byte < 4 for r in held)
    assert lm.score(nothing).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[50:90] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7 + [None]), (None, [1.0] * 8), (1050, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(vectors).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 400, 50):
        score = np.round(unit @ unit[q], 9)
        order = [k for k in np.lexsort((np.arange(400), -score)) if k != q][:5]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == order
    assert len(found) == 40 and neighbours.nearest(vectors.limit(0)).count() == 0


def test_lm_weights_last():
    """Texts side by side against one bit after another, also long and repetitive ones."""
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice("the of and to river stone walked under".split(), n))
    texts = [say(n) for n in (1, 600, 30, 300, 5, 200, 90)] + ["", "abc" * 500]
    ends = np.cumsum([0] + [len(t) for t in texts])
    sym, starts = lm._symbols(np.frombuffer("".join(texts).encode(), np.uint8), ends)
    contexts = lm._contexts(sym, starts, lm.WordHasher())
    cells = np.zeros(lm.CELLS)
    for k in range(3):
        np.add.at(cells, lm._BASE[k] + contexts[k][:3000].astype(np.int64) * 256 + sym[:3000], 1)
    code = lm.Code(np.bincount(sym, minlength=256))
    tables = lm.odds(cells, code)
    wanted = []
    for a, b in zip(starts[:-1], starts[1:]):
        weights, total = np.full((lm.GATES, 3), lm.START), 0.0
        for k in range(a, b):
            first = code.first[sym[k]]
            for depth in range(code.length[sym[k]]):
                node, bit, gate = code.node[first + depth], code.bit[first + depth], min(depth, lm.GATES - 1)
                x = np.array([tables[lm._BASE[j] + int(contexts[j][k]) * 256 + node] / 16 for j in range(3)])
                p = 1 / (1 + np.exp(-weights[gate] @ x))
                total += np.log(np.clip(p if bit else 1 - p, 1e-4, 1 - 1e-4))
                weights[gate] += lm.RATE * (bit - p) * x
        wanted.append(total)
    found = lm.log_probability(sym, starts, tables, code, lm.WordHasher())
    np.testing.assert_allclose(found, wanted, rtol=1e-5)


def test_lm_streams(monkeypatch):
    """Codes deeper than there are gates, texts in several blocks and pieces: each
    bit against one after another, all bits beyond the last gate sharing its weights."""
    monkeypatch.setattr(lm, "LANES", 12, raising=False)
    monkeypatch.setattr(lm, "SCORED", 100)
    monkeypatch.setattr(lm, "CONTEXT_RUN", 64, raising=False)
    rng = np.random.default_rng(8)
    counts = np.zeros(256)
    counts[97:157] = 300 * 2.0 ** np.arange(60)  # a code of some 60 bits for the rarest
    texts = [rng.choice(np.r_[97:107, 120:130, 150:157], n).astype(np.uint8) for n in [40] * 9 + [90, 0, 1, 300, 33, 20] * 3]
    code, sizes = lm.Code(counts), [len(x) for x in texts]
    assert code.length.max() > lm.GATES + 8
    sym, starts = lm._symbols(np.concatenate(texts), np.cumsum([0] + sizes))
    contexts = lm._contexts(sym, starts, lm.WordHasher())
    for text, a, b in zip(texts, starts[:-1], starts[1:]):  # no text sees another
        alone = lm._contexts(*lm._symbols(text, np.array([0, len(text)])), lm.WordHasher())
        assert all((x[a:b] == y).all() for x, y in zip(contexts, alone))
    tables = rng.integers(-60, 60, lm.CELLS).astype(np.int8)
    wanted = []
    for a, b in zip(starts[:-1], starts[1:]):
        weights, total = np.full((lm.GATES, 3), lm.START), 0.0
        for k in range(a, b):
            for depth in range(code.length[sym[k]]):
                node, bit = code.node[code.first[sym[k]] + depth], code.bit[code.first[sym[k]] + depth]
                x = np.array([tables[lm._BASE[j] + int(contexts[j][k]) * 256 + node] / 16 for j in range(3)])
                p = 1 / (1 + np.exp(-weights[min(depth, lm.GATES - 1)] @ x))
                total += np.log(np.clip(p if bit else 1 - p, 1e-4, 1 - 1e-4))
                weights[min(depth, lm.GATES - 1)] += lm.RATE * (bit - p) * x
        wanted.append(total)
    found = lm.log_probability(sym, starts, tables, code, lm.WordHasher())
    np.testing.assert_allclose(found, wanted, rtol=1e-5)


def test_near_at_eighty(spark):
    """Pairs similar by 0.80 to 0.84, also of sets of 4 and 5 shingles."""
    texts = {}
    for n, more in ((4, 1), (5, 1), (21, 4), (40, 10), (50, 10), (3, 1), (30, 8)):  # shingles, and those added
        words = [f"n{n}-{k}" for k in range(n + 4 + more)]
        texts[n, False], texts[n, True] = " ".join(words[: n + 4]), " ".join(words)
    rows = [(k, t) for k, t in enumerate(texts.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    sets = [_shingles(t) for _, t in rows]
    linked = {k + 1 for k in range(0, len(rows), 2) if len(sets[k] & sets[k + 1]) * 100 >= 80 * len(sets[k] | sets[k + 1])}
    assert linked == {1, 3, 5, 7, 9} and kept == set(range(len(rows))) - linked
    assert near_dedup.keep_one(docs).count() == len(rows)
    assert near_dedup.matches(85) == 16 and near_dedup.matches(80) == 14


def test_near_keeps_one_row(spark):
    """Repeated and null doc_ids: rows are judged by their own text."""
    say = lambda name, edit=0: " ".join(f"{name}{k}" for k in range(60)) + " end" * edit
    rows = [(1, say("a")), (2, say("a", 1)), (2, say("b")), (None, say("c")), (None, say("c", 1)), (None, say("d"))]
    rows += [(3, say("e")), (3, say("e")), (4, say("f")), (4, say("f", 1)), (None, say("g")), (5, say("g", 1)), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, own long")
    kept = near_dedup.keep_one(docs)
    left = Counter((r.doc_id, (r.text or "")[:1]) for r in kept.collect())
    wanted = [(1, "a"), (2, "b"), (None, "c"), (None, "d"), (3, "e"), (4, "f"), (5, "g"), (6, ""), (6, ""), (None, "")]
    assert left == Counter(wanted) and kept.columns == docs.columns


def test_neighbours_of_unread_files(spark):
    """More pivots than a query probes, and a group of copies."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 8))
    x[100:180] = x[50]
    assert len(x) // 8 > neighbours.PROBES
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(vectors).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        score = np.round(unit @ unit[q], 9)
        order = [k for k in np.lexsort((np.arange(1500), -score)) if k != q][:5]
        hits += len(set(order) & set(found[q].values()))
        if q in (50, 100, 150):
            assert [found[q][k] for k in range(1, 6)] == order
    assert len(found) == 30 and hits >= 0.95 * 150, hits


def test_pipeline(spark, tmp_path):
    """Every stage over what its predecessor kept, and the whole, by brute force."""
    rng = np.random.default_rng(8)
    say = lambda words, n: " ".join(rng.choice(words.split(), n))
    english, french = "the of and to river stone walked under", "le de été où forêt marché être sous"
    rows = [(k, say(english if k < 40 else french, 60), "en" if k < 40 else "fr", "ab"[k % 2]) for k in range(80)]
    rejects = [(100, None), (101, ""), (102, " \t"), (103, "!!! 123"), (104, "漢字 漢字 漢字")]
    copies = [(200 + k, rows[k][1], *rows[k][2:]) for k in range(5)]
    edits = [(300 + k, rows[k][1] + " " + " ".join(f"end{j}" for j in range(1 + 10 * (k % 2))), *rows[k][2:]) for k in range(50, 56)]
    table = rows + [(i, t, None, "a") for i, t in rejects] + copies + edits
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["identify", "exact", "near", "mix", "encode"]

    def stage(name, docs):
        return spark.createDataFrame(stages[name](spark, docs, str(tmp_path)).collect(), schema)

    ids = lambda docs: {r.doc_id for r in docs.collect()}
    one = stage("identify", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert ids(one) == {r[0] for r in table} - {r[0] for r in rejects}
    two = stage("exact", one)  # the largest doc_id stays
    assert ids(two) == ids(one) - set(range(5)) and two.count() == len(ids(two))
    three = stage("near", two)
    kept = sorted((r.doc_id, r.text) for r in two.collect())
    gone, sets = set(), {i: _shingles(t) for i, t in kept}
    for a, _ in kept:
        gone |= {b for b in sets if b > a and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])}
    assert gone == {300 + k for k in range(50, 56)} and ids(three) == ids(two) - gone
    taken = Counter({r.doc_id: r.copies for r in mixing.mix(three).collect()})
    four = stage("mix", three)
    assert Counter(r.doc_id for r in four.collect()) == +taken and all(n <= 3 for n in taken.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in table}
    said = {i: " ".join(map(str, library.encode(texts[i], add_special_tokens=False).ids)) for i in taken}
    wanted = Counter((i, hashlib.sha256(said[i].encode()).hexdigest()) for i in taken.elements())
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == wanted
