"""Whole answers of operators without SQL, against plain loops written apart from them."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from narrowmat.llm import language, licenses, mixing, rans
from narrowmat.llm.common import scratch

MANY = 40  # languages; two bits for each do not fit one mask


def _trigrams(text):
    line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    return [line[k - 1 : k + 2] for k in range(1, len(line) - 1) if line[k] != " "]


def _language_rows():
    rng = np.random.default_rng(11)
    stems = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß漢字"), 5)) for _ in range(12)] for _ in range(MANY)]
    rows = []
    for k in range(400):
        own = stems[k % MANY] + stems[0][:2]  # two words of the first language in all
        rows.append((k, " ".join(rng.choice(own, 25)), f"l{k % MANY:02}"))
    long = " ".join(rng.choice(stems[3], 60_000))
    rows += [(900, long, "l03"), (901, None, "l01"), (902, "12 !?", "l01"), (903, " ".join(stems[5]), None)]
    return [*rows, rows[7], rows[7], (None, rows[9][1], "l09")]


def test_language_is_that_of_plain_counts(spark):
    rows = _language_rows()
    counts, totals = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if text and lang and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(_trigrams(text))
    totals = {s: sum(c.values()) for s, c in counts.items()}
    top = Counter()
    for s, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / totals[s])
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    texts = {i: text for i, text, _ in rows}
    for r in found:
        grams = _trigrams(texts[r.doc_id])
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        share = {
            s: sum((g in c) + (c[g] / totals[s] * 3 >= top[g] > 0) for g in grams) / 2 / len(grams) for s, c in counts.items()
        }
        best = max(share.values())
        assert r.score == pytest.approx(best, abs=0.02) and share[r.lang_pred] >= best - 0.02


def test_language_masks_hold_every_gram(spark):
    rows = [(k, t, s) for k, t, s in _language_rows()[:120]]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.masks.shape[0] == 2 and len(model.languages) == MANY
    for _, text, lang in rows:
        codes = np.array([sum(ord(c) << (42 - 21 * k) for k, c in enumerate(g)) for g in set(_trigrams(text))], dtype=np.uint64)
        bit = 2 * model.languages.index(lang)
        word, place = divmod(bit, language.WORD_BITS)
        for cells in language._cells(codes, model.masks.shape[1]):
            assert (model.masks[word][cells] >> np.uint64(place) & np.uint64(1)).all()


def test_archive_is_read_from_its_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    long = " ".join("".join(rng.choice(list("abcde"), 6)) for _ in range(60_000))  # fills more than one block
    texts = {1: "one", 2: long, 3: "", 4: "after <|endoftext|> it", 5: long[:300_000], 6: "é 漢"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    folder = scratch(spark, "test")
    rans.write_archive(docs, path, folder)
    other = spark.newSession()
    found = {r.doc_id: r for r in rans.read_archive(other, folder).collect()}
    pieces = rans.read_pieces(other, folder, ids=True).orderBy("part", "first").collect()
    assert max(Counter(p.doc_id for p in pieces).values()) > 1
    start = 0
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [rans.END_ID]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), crc)
        assert [x for p in pieces if p.doc_id == i for x in p.ids] == ids
        start += len(ids)


def test_mix_of_one_id_is_the_same_in_any_order(spark):
    rows = [(1, f"w{k} x", "a") for k in range(40)] + [(None, f"n{k} y", "b") for k in range(40)] + [(2, "z " * 70, "c")]
    rng = np.random.default_rng(8)
    answers = []
    for parts in (1, 3, 5, 8):
        mixed = [rows[k] for k in rng.permutation(len(rows))]
        docs = spark.createDataFrame(mixed, "doc_id long, text string, source string").repartition(parts)
        answers.append(Counter((r.text, r.copies) for r in mixing.mix(docs).collect()))
    assert all(a == answers[0] for a in answers)
    assert len({n for (_, n) in answers[0]}) > 1


def test_targets_by_bisection():
    rng = np.random.default_rng(4)
    for _ in range(200):
        names = [*(f"s{k}" for k in range(rng.integers(1, 9))), None]
        sizes = {s: int(10 ** rng.uniform(0, 6)) for s in names}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        low, high = 0.0, 1e9
        for _ in range(200):
            level = (low + high) / 2
            if sum(min(3 * sizes[s], level * weight[s]) for s in names) < sum(sizes.values()):
                low = level
            else:
                high = level
        goal = mixing.targets(sizes)
        assert all(goal[s] == pytest.approx(min(3 * sizes[s], high * weight[s]), rel=1e-6) for s in names)


def test_base_of_licences_is_that_of_plain_search(spark):
    rng = np.random.default_rng(6)
    pool = "cc by general public license all rights reserved CC BY SA gnu mit é 4 0 spdx".split()
    marks = [" ", "  ", "\n", "-", ", ", "\x00", "/", "\x7f", " "]
    rows = [(None, None), (0, ""), (1, "cc"), (2, "cc by cc by"), (3, "all rights " * 50_000 + "reserved")]
    for k in range(4, 400):
        rows.append((k, "".join(w + marks[rng.choice(9, p=[0.5] + [0.0625] * 8)] for w in rng.choice(pool, rng.integers(1, 60)))))
    rows += rows[-3:]
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    wanted = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        first = [k for k, _ in hits]
        wanted[i, len(words), len(hits), min(first, default=None), max(first, default=None), ",".join(sorted({s for _, s in hits}))] += 1
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == wanted
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
