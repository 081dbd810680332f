import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import jaccard_join, language_id, licences, piece_sampling, pii, suffix_tree, text, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(frame, key="doc_id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], []).append(r.asDict())
    return out


@pytest.mark.parametrize("run", [
    lambda d: licences.scan(d, licences.known_digests(d.sparkSession)), lambda d: piece_sampling.round_trip(d, PIECES), lambda d: piece_sampling.encode(d, PIECES), lambda d: pii.find_pii(d, pii.learn(d), mask=True),
    lambda d: language_id.identify(d, language_id.learn(d)), lambda d: jaccard_join.similar(d), lambda d: suffix_tree.score(d, *suffix_tree.grow(d)), lambda d: token_counts.count_tokens(d, BPE),
])
def test_every_row_once_whatever_the_columns(run, docs, clashing, empty, cases):
    assert sorted(Counter(r[0] for r in cases).items(), key=str) == sorted(Counter(r.doc_id for r in run(clashing).collect()).items(), key=str)
    out = run(empty)
    assert out.count() == 0 and "doc_id" in out.columns


# Shared arrays


def test_words_and_hashes():
    parts = ["a bc d", "", " x\ty\r\n", "a"]
    import pyarrow as pa

    data, offsets = text.buffer_of(pa.array([*parts, None]))
    s, e, edges = text.word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
    assert [words[a:b] for a, b in zip(edges, edges[1:], strict=False)] == [["a", "bc d"], [], ["x", "y"], ["a"], []]
    h = text.span_hashes(data, s, e)
    assert h[0] == h[-1] and len(set(h.tolist())) == 4


def patterned(steps: int = 10) -> tuple[str, str]:
    """A word of two letters in the order of their parities (Thue and Morse), and its complement: a polynomial hash modulo
    2^64 maps both to one value."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_patterned_words_have_hashes_of_their_own():
    import pyarrow as pa

    words = [*patterned(10), *patterned(11), "a", "a" * 8, "a" * 9, "a" * 16, "a\x00", "a\x00\x00", "bb" + "a" * 8, "a" * 8 + "bb"]
    data, offsets = text.buffer_of(pa.array([*words, " ".join(words)]))
    s, e, _ = text.word_spans(data, offsets)
    h = text.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()
    assert len(text.word_hashes(data, s[:0], e[:0])) == 0


def test_patterned_words_stay_apart_in_joins_and_counts(spark):
    a, b = patterned()
    d = spark.createDataFrame([(1, f"{a} {b} {a} {b} {b} {a}"), (2, f"{a} {b} {b} {a} {a} {a}"), (3, f"{b} {b} {b} {b} {b} {b}"), (4, b)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(d, percent=90, width=3).collect()}
    assert got == {1: (4, 1), 2: (4, 2), 3: (1, 3), 4: (1, 4)}
    tree, counts = suffix_tree.grow(d.filter("doc_id = 1"))
    r = {r.doc_id: r for r in suffix_tree.score(d, tree, counts).collect()}
    assert (r[3].n_known, r[4].n_tokens, r[1].train_tokens) == (7, 2, 7)
    assert r[3].base_score == pytest.approx(6 * math.log10(4 / 11) + math.log10(2 / 11)) and r[1].base_score == pytest.approx(6 * math.log10(4 / 11) + math.log10(2 / 11))


def test_folds(spark):
    got = spark.range(50).select("id", text.fold("id", 5, 0).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# 1


def test_licence_spellings(spark):
    mit = licences.KNOWN["MIT"]
    odd = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("\"", "“").replace("\n\n", "\r\n\r\n") + "  "
    d = spark.createDataFrame([(1, mit), (2, odd), (3, mit + " And more."), (4, "Copyright 2020 Ann"), (5, "licensed under the apache licence version 2.0")], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.canon_chars) for r in licences.scan(d, licences.known_digests(spark)).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["MIT", "MIT", None, None, "Apache-2.0 notice"] and got[4][1] == 0


def test_licence_files(spark):
    mit, bsd = licences.KNOWN["MIT"], licences.KNOWN["BSD-3-Clause"]
    heads = ["MIT License\n\nCopyright (c) Jane Doe\n\n", "The MIT License (MIT)\n\nCopyright (c) [year] [fullname]\n\n", "# Copyright 2020 X\n", " * Copyright 2020 X\n * All rights reserved.\n", "Copyright © Jane Doe. All Rights Reserved.\n\n", "(c) 2020 X\nAll rights reserved\n", "Copyright 2019 A\nCopyright <year> <owner>\n\nMIT License\n\n"]
    commented = "/*\n * Copyright 2020 X\n *\n" + "".join(f" * {line}\n" for line in mit.split("\n")) + " */\n"
    rows = [(f"MIT/{i}", h + mit) for i, h in enumerate(heads)] + [("MIT/c", commented), ("BSD-3-Clause/0", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + bsd)]
    rows += [(f"{k}/own", t) for k, t in licences.KNOWN.items()]
    rows += [("None/0", mit + "\ncopyright notice and this permission notice"), ("None/1", bsd.replace("3. Neither", "3. Either")), ("None/2", "MIT License\n\nCopyright (c) Jane Doe\n")]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string"), licences.known_digests(spark)).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: k.split("/")[0] for k, _ in rows}
    assert {"BSD-2-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"} <= set(licences.KNOWN)


# 2


def test_round_trip_is_lossless(docs):
    for rows in rows_of(piece_sampling.round_trip(docs, PIECES, seed=3)).values():
        assert all(r["lossless"] in (True, None) for r in rows) and len({str(r) for r in rows}) == 1


def test_decode_gives_the_text(docs, cases):
    got = rows_of(piece_sampling.decode(piece_sampling.encode(docs, PIECES, seed=3), PIECES))
    assert all(got[i][0]["text"] == t for i, t, *_ in cases)


def test_pieces_follow_key_and_seed_alone(docs):
    one = {r.doc_id: r.pieces for r in piece_sampling.encode(docs, PIECES, seed=3).collect()}
    two = {r.doc_id: r.pieces for r in piece_sampling.encode(docs.coalesce(1), PIECES, seed=3).collect()}
    other = {r.doc_id: r.pieces for r in piece_sampling.encode(docs, PIECES, seed=4).collect()}
    assert one == two and one[4] != other[4] and one[0] != one[1]


def test_sampling_matches_enumeration():
    import pyarrow as pa

    v = piece_sampling._vocabulary(PIECES, 1.0)
    known = {v.pieces[i].decode(): i for i in v.ids}

    def every(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                yield from ((known[s[:k]], *rest) for rest in every(s[k:]))

    ways = list(every(" hello"))
    chance = np.array([math.exp(sum(v.log_weight[i] for i in w)) for w in ways])
    n = 60_000
    data, offsets = text.buffer_of(pa.array([" hello"] * n))
    ids, at = piece_sampling.encode_block(v, data, offsets, text.mix(np.arange(n, dtype=np.uint64)), 7)
    seen = Counter(tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(ways)
    assert max(abs(seen[w] / n - p) for w, p in zip(ways, chance / chance.sum(), strict=True)) < 0.01


# 3


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_equals_plain_patterns(cases):
    r = random.Random(3)
    made = ["".join(r.choice("0123456789  ..--+()@@abZ%_é1234") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for t in [*made, *(c[1] or "" for c in cases)]:
        assert pii.base_spans(t) == plain_spans(t)


def test_crf_recovers_and_adds(spark):
    r = random.Random(5)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        head = num(15)
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    texts = [f"words here {r.choice(['call', 'at'])} +1 ({num(3)}) 555-{num(4)} x pay {card()} now" for _ in range(60)] + [f"order {num(6)} of {num(8)} pieces" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, f"so +1 (212) 555-0100 {card()} end"), (1001, "plain text 1234567 here")]
    model = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    base, added = pii.find(rows[-2][1], model)
    assert base == [] and sorted(k for k, *_ in added) == ["card", "phone"]
    assert pii.find(rows[-1][1], model) == ([], [])
    assert pii.find(texts[0], model)[0] == plain_spans(texts[0])
    assert pii.masked_text(rows[-2][1], added) == "so [PHONE] [CARD] end"


def test_long_texts_take_linear_time():
    began = time.time()
    assert pii.base_spans("1" * 1_000_000 + ".1.1 .1.1") == [] and len(pii.base_spans("1.1.1.1 " * 50_000)) == 50_000
    model = pii.Model.zero()
    for t in ("1" * 500_000, "12345678 " * 8000, "1.2" * 40_000, "a@" * 40_000, "a.b(at)" * 20_000, "+1(" * 40_000):
        pii.find(t, model)
    assert time.time() - began < 60


def test_decoding_equals_enumeration():
    r = np.random.default_rng(4)
    for text_ in ("so +1 (212) 555-0100 x", "a.b(at)c.org 10[.]0[.]0[.]1", "pay 4539/1488/0343/6467 555 1234567"):
        bounds, segs = pii.segments(text_)
        for _ in range(20):
            model = pii.Model(r.standard_normal((4, pii._DIM)), r.standard_normal((5, 5)))
            best = (-np.inf, [])

            def walk(at, last, score, spans):
                nonlocal best
                if at == len(bounds) - 1:
                    best = max(best, (score, spans))
                    return
                walk(at + 1, 0, score + model.move[last, 0], spans)
                for i, j, f in segs:
                    if i == at:
                        for y in range(4):
                            walk(j, y + 1, score + model.move[last, y + 1] + model.emit[y, f].sum(), [*spans, (pii.KINDS[y], bounds[i], bounds[j])])

            walk(0, 0, 0.0, [])
            assert pii.decode(model, bounds, segs) == best[1]


def spelt_cases(seed, n):
    """Texts with personal data written so that the base can't find it, the spans, and texts with harmless numbers."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("123456789") for _ in range(k))
    word = lambda: r.choice("garden river letter market window bridge".split())
    planted, harmless = [], []
    for _ in range(n):
        made = [("email", r.choice([f"{word()}.{word()}(at){word()}.org", f"{word()}{num(2)}[at]{word()}[dot]com"])), ("ip", f"{r.randint(1, 255)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(1, 255)}"), ("card", "/".join(num(4) for _ in range(4))), ("phone", f"({num(3)}) {num(3)}-{num(4)}")]
        kind, value = r.choice(made)
        head = f"{word()} {word()} " * r.randint(1, 4)
        planted.append((f"{head}{value} and {word()}", (kind, len(head), len(head) + len(value))))
        harmless.append(f"{head}{r.choice([num(6), num(8), f'{num(1)},{num(3)},{num(3)}', f'20{num(2)}-1{num(1)}-2{num(1)}', f'{num(1)}.{num(2)}.{num(3)}', f'{num(4)}/{num(4)}', f'{word()} (at {word()})'])} and {word()}")
    return planted, harmless


def test_crf_finds_what_the_base_misses(spark):
    r = random.Random(6)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    card = lambda: next(h + d for h in [num(15)] for d in "0123456789" if pii.luhn(h + d))
    plain = [r.choice([f"mail a{num(2)}.bc@site{num(1)}.org now", f"host 10.{r.randint(0, 255)}.0.{r.randint(1, 255)} is up", f"pay {card()} please", f"call +1 ({num(3)}) {num(3)}-{num(4)} soon"]) for _ in range(160)]
    planted, harmless = spelt_cases(1, 100)
    _, seen = spelt_cases(2, 100)
    d = spark.createDataFrame(list(enumerate(plain + seen)), "doc_id long, text string")
    model = pii.learn(d)
    found = [pii.find(t, model) for t, _ in planted]
    assert all(base == [] for base, _ in found)
    hits = sum(span in added for (_, span), (_, added) in zip(planted, found, strict=True))
    wrong = sum(len(pii.find(t, model)[1]) for t in harmless) + sum(len(added) for _, added in found) - hits
    print("recall", hits / 100, "precision", hits / max(1, hits + wrong))
    assert hits >= 80 and wrong <= 10


# 4


def test_profiles_equal_brute_force(docs, cases):
    counts = {}
    for _, t, lang, *_ in cases:
        if lang and t:
            c = counts.setdefault(lang, Counter())
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                p = f" {w} "
                c.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    want = {k: [code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:400]] for k, c in counts.items()}
    assert {k: v.tolist() for k, v in language_id.learn(docs).items()} == want


def test_languages(spark):
    en, de = "the river and the stone are under the bridge with them", "der Fluss und der Stein sind unter der Brücke mit ihnen"
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(40)]
    profiles = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the stone and the river"), (2, "Der Stein UND die Brücke"), (3, "123"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, profiles).collect()}
    assert [got[i].lang_pred for i in range(1, 5)] == ["en", "de", "und", "und"] and got[3].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(asked, {}).collect()} == {"und"}


# 5


def classes(rows, percent=90):
    sets = {i: jaccard_join.word_set(t or "", 3) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_join_equals_brute_force(docs, cases):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(docs).collect()}
    assert got.pop(None) == (1, None) and got == classes(cases)


def test_family_that_drifts_apart(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(3):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 40, 150]))]
        for _ in range(60):
            words = list(base)
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary[:40])
            rows.append((len(rows), " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 70):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar(d, percent=percent).collect()} == classes(rows, percent)


# 6


def test_base_scores_and_counts(docs, cases):
    tok = lambda t: [*(t or "").encode().lower().split(), "END"]
    train = [c for c in cases if c[0] is None or zlib.crc32(str(c[0]).encode()) % 7 != 2]
    c = Counter(w for x in train for w in tok(x[1]))
    n, v = sum(c.values()), len(c)
    tree, counts = suffix_tree.grow(docs.filter(~text.fold("doc_id", 7, 2)), heads=50)
    got = rows_of(suffix_tree.score(docs, tree, counts))
    for i, t, *_ in cases:
        r, words = got[i][0], tok(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in c for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words))
    assert len(tree.heads.words) <= 50


def tree_score(train, others, depth, support=2):
    """The same model from dictionaries: log10 of each text's probability, and how many states it has."""
    c = Counter(w[i:j] for w in train for i in range(len(w)) for j in range(i + 1, min(len(w), i + depth + 1) + 1))
    n = sum(len(w) for w in train)
    den = n + sum(len(g) == 1 for g in c) + 1
    entries, rest = {}, {}
    for g, m in c.items():
        if len(g) > 1 and m >= support:
            entries.setdefault(g[:-1], {})[g[-1]] = m

    def p(context, word):
        for cut in range(len(context) + 1):
            state = context[cut:]
            if state in rest:
                return rest[state] * p(state[1:], word) + max(entries[state].get(word, 0) - 0.75, 0) / c[state]
        return (c[(word,)] + 1) / den

    for length in range(1, depth + 1):
        new = {}
        for x, after in entries.items():
            if len(x) == length:
                below = {w: p(x[1:], w) for w in after}
                left = c[x] - sum(after.values())
                gained = sum(m * math.log(m / c[x] / below[w]) for w, m in after.items())
                gained += left * math.log(left / c[x] / (1 - sum(below.values()))) if left else 0
                if gained > 0.5 * len(after) * math.log(n):
                    new[x] = (left + 0.75 * len(after)) / c[x]
        rest |= new
    return [sum(math.log10(p(w[max(0, i - depth) : i], w[i])) for i in range(len(w))) for w in others], rest


def chained(seed, rows, order):
    """Texts in which a word mostly follows from the ``order`` words before it."""
    r = random.Random(seed)
    texts = []
    for _ in range(rows):
        w = [r.choice("abcd") for _ in range(order)]
        for _ in range(r.randrange(0, 40)):
            w.append("abcd"[sum(map(ord, w[-order:])) * 7 % 4] if r.random() < 0.8 else r.choice("abcdefghij"))
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("order", "depth", "support"), [(1, 1, 2), (1, 2, 8), (2, 2, 2), (3, 4, 3)])
def test_tree_equals_dictionaries(spark, order, depth, support):
    texts = [*chained(order, 120, order), "", None, "never seen words", "a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    tree, counts = suffix_tree.grow(d.filter("doc_id % 4 != 0"), heads=20, depth=depth, support=support)
    words = [(*(t or "").split(), "END") for t in texts]
    wanted, states = tree_score([w for i, w in enumerate(words) if i % 4], words, depth, support)
    assert states and tree.rests.count() == len(states)
    got = rows_of(suffix_tree.score(d, tree, counts))
    assert [got[i][0]["score"] for i in range(len(texts))] == pytest.approx(wanted)
    assert sum(r[0]["score"] for r in got.values()) > 0.9 * sum(r[0]["base_score"] for r in got.values())


def test_what_stands_twice_is_learnt_at_any_size(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(400)]
    for rows in (50, 400):
        d = spark.createDataFrame(list(enumerate([*texts[:rows], texts[0]])), "doc_id long, text string")
        got = {i: x[0]["score"] - x[0]["base_score"] for i, x in rows_of(suffix_tree.score(d, *suffix_tree.grow(d, support=2))).items()}
        assert got[0] == got[rows] > 2 * max(got[i] for i in range(1, rows))


def test_groups_of_texts(spark, monkeypatch):
    d = spark.createDataFrame(list(enumerate(chained(1, 60, 2))), "doc_id long, text string").repartition(2, "doc_id")
    tree, counts = suffix_tree.grow(d)
    whole = {i: x[0]["score"] for i, x in rows_of(suffix_tree.score(d, tree, counts)).items()}
    monkeypatch.setattr(suffix_tree, "_GROUP", 100)
    monkeypatch.setattr(suffix_tree, "_ENTRIES", 64)  # most entries and states are looked up
    tree, counts = suffix_tree.grow(d)
    assert 0 < len(tree.heads.gains[0]) < tree.gains.count()
    assert {i: x[0]["score"] for i, x in rows_of(suffix_tree.score(d, tree, counts)).items()} == pytest.approx(whole)


# 7


def test_counts_equal_the_library(docs, cases):
    plain = token_counts.Encoder.at(BPE).plain
    got = rows_of(token_counts.count_tokens(docs, BPE, huge_chars=1000, overlap_chars=40, limit=50))
    for i, t, *_ in cases:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[i][0]["n_tokens"], got[i][0]["n_bytes"], got[i][0]["over_limit"]) == (n, len((t or "").encode()), n > 50)


@pytest.mark.parametrize(("chunk", "overlap"), [(1000, 64), (100, 8), (37, 5)])
def test_splices(chunk, overlap):
    import pyarrow as pa

    e = token_counts.Encoder.at(BPE)
    odd = ["a<|endoftext|> b<|endoftext|>" * 300, "x" * 3000, "  \n  a  b 　 c   d " * 200, "don't we'll <|endof text|> 12 34\t\t \n", "é è  ", "a \u0085 b\x1c c", None, "word " * 2000, "\n" * 1500 + "a", "日本語 テキスト" * 200]
    assert token_counts._count_block(e, pa.array(odd), chunk, overlap)[1].tolist() == [len(e.plain.encode(x or "", add_special_tokens=False).ids) for x in odd]


def test_digest_of_spans():
    assert pii.digest("") == hashlib.sha256(b"").hexdigest()


def test_the_suffix_tree_leaves_no_broadcast_or_level_and_sends_its_heads_packed(spark, docs, monkeypatch):
    import os
    import pickle

    import numpy as np

    sent, made = [], []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value, old=type(spark.sparkContext).broadcast: sent.append(old(self, value)) or sent[-1])
    monkeypatch.setattr(suffix_tree, "stored", lambda frame, name, paths=None, old=suffix_tree.stored: made.append((name, old(frame, name, paths))) or made[-1][1])
    heads = suffix_tree.grow(docs)[0].heads
    assert len(sent) >= 4 and not any(os.path.exists(x._path) for x in sent)
    assert not any(os.path.exists(f.removeprefix("file:")) for name, frame in made if name == "level" for f in frame.inputFiles())
    heads.words, heads.counts = np.sort(np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(50_000)
    heads.rest = np.ones(50_000)
    data = pickle.dumps(heads)
    again = pickle.loads(data)
    assert len(data) < 12 * 50_000 + len(heads.bits) * 8
    for name in ("words", "counts", "rest", "bits"):
        assert (getattr(again, name) == getattr(heads, name)).all() and getattr(again, name).dtype == getattr(heads, name).dtype
    for name in ("gains", "rests"):
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(getattr(again, name), getattr(heads, name), strict=True))


def test_a_spent_tree_has_left_no_tables_and_the_same_scores(spark, docs):
    import os

    tree, counts = suffix_tree.grow(docs)
    there = lambda: [os.path.exists(p.removeprefix("file:")) for p in tree.paths]
    whole = rows_of(suffix_tree.score(docs, tree, counts))
    assert len(tree.paths) > 2 and all(there())
    paths = list(tree.paths)
    spent = suffix_tree.score(docs, tree, counts, spend=True)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    assert rows_of(spent) == whole
