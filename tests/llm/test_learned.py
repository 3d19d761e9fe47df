"""Tokens, packing, languages, personal data, neighbours and near duplicates against plain forms."""

import random
import re

import numpy as np
import pytest

from lexloom.llm import arrays, bpe, language_id, near_duplicates, nearest, packing, personal_data

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", "  a  b\n\n c \t", "don't WE'LL 'tis ''s it'S", "<|endoftext|>a<|endoftext|>", "　x\xa0y é́ ñ ٣ Ⅷ ½ 漢字 😀👍🏽", "İ ΣΑΣ", "'re!'s", "\u0085a"]


def odd_texts(n=3000):
    rng = random.Random(3)
    letters = "abcdeABC '  \n.,!?0123é漢😀\t\xa0strelvdm"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["ab " * 50_000]


def test_byte_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs, ours, texts = Tokenizer.from_file(path), bpe.codec(path), odd_texts()
    for ids, ref in zip(ours.encode(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == ref.ids
        assert ours.automaton.decode(ids) == theirs.decode(ref.ids, skip_special_tokens=False)
    assert [len(x) for x in ours.encode([None, ""])] == [0, 0]


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts()
    for ids, ref in zip(packing.codec(path).encode(texts), Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == ref.ids


def test_plans_place_every_piece_once():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        made, seen = packing.plan(counts, 64), {}
        for pattern, n in made:
            assert n > 0 and sum(pattern) <= 64
            for x in pattern:
                seen[x] = seen.get(x, 0) + n
        assert seen == counts
    assert packing.plan({40: 3, 24: 3, 10: 2, 54: 2}, 64) and sum(n for _, n in packing.plan({40: 3, 24: 3, 10: 2, 54: 2}, 64)) == 5
    assert packing.plan({}) == []


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, "word " * (i * 37 % 900)) for i in range(120)] + [(500, None), (501, ""), (None, "x"), (7, "again"), (502, "long " * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 3
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_forward_backward_in_blocks_is_exact():
    chain = language_id.Chain(["a", "b", "c"])
    rng = np.random.default_rng(0)
    chain.pairs, chain.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [5, 100, 33, 1, 64]
    emit, doc = rng.normal(size=(sum(sizes), 3)) * 2, np.repeat(np.arange(5), sizes)
    got = chain.marginals(emit, doc)
    for i in range(5):
        assert np.allclose(got[doc == i], chain._expected(emit[doc == i][None])[0][0])


def test_languages_of_held_out_texts(spark):
    words = {"en": "the of and to in is that with for on", "fr": "le la les de des et que pour dans une", "de": "der die und das nicht ein ist mit auf sich"}
    rng = random.Random(0)
    rows = []
    for i in range(300):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(3, 60))), lang if i % 4 else None, i))
    truth = {r[0]: next(k for k, v in words.items() if r[1].split()[0] in v.split()) for r in rows}
    rows += [(1000, None, "en", 0), (1001, "123 !", "fr", 0), (1002, "", None, 0), (None, "the of and", None, 0), (1003, "the of " * 20_000, None, 0)]
    out = language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth and r["held_out"]]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1000, 1001, 1002, 1003)} == {1000: "und", 1001: "und", 1002: "und", 1003: "en"}
    assert all(0 <= r["score"] <= 1 for r in out)
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.digest(nothing).collect()] == ["und"]
    assert language_id.digest(nothing.limit(0)).count() == 0


def test_a_language_of_short_texts_only_is_learned(spark):
    words = {"en": "the of and to in is that with for on", "fr": "le la les de des et que pour dans une"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(n)), lang) for i, (lang, n) in enumerate([("en", 60), ("fr", 12)] * 100)]
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i] == lang for i, _, lang in rows) >= 198


def test_masked_sequences_are_exact():
    chain = language_id.Chain(["a", "b", "c"])
    rng = np.random.default_rng(5)
    chain.pairs, chain.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    emit = rng.normal(size=(2, 6, 3))
    there = np.array([[True] * 6, [True] * 4 + [False] * 2])
    got, pairs = chain._expected(emit, there)
    one, two = chain._expected(emit[:1]), chain._expected(emit[1:, :4])
    assert np.allclose(got[0], one[0][0]) and np.allclose(got[1, :4], two[0][0]) and not got[1, 4:].any()
    assert np.allclose(pairs, one[1] + two[1])


def test_languages_of_odd_tables(spark):
    clash = ["lang_pred", "score", "held_out", "part", "rows"]
    rows = [(i, "the of and to in is" if i % 2 else "le la les de des", "en" if i % 2 else "fr", *["x"] * 5) for i in range(40)]
    rows += [(7, rows[7][1], "en", *["x"] * 5), (90, None, "en", *["x"] * 5), (91, "?!", None, *["x"] * 5), (None, "the of and", "fr", *["x"] * 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, " + ", ".join(f"{c} string" for c in clash))
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert {r["score"] for r in kept.collect()} == {"x"}
    assert language_id.keep_known(df.limit(0)).count() == 0
    assert [f.name for f in language_id.digest(df).schema] == ["doc_id", "held_out", "lang_pred", "score"]


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab0123.@-+ ()1234567 %_") for _ in range(rng.randint(1, 60))) for _ in range(20_000)]
    bits = ["1.2.3.4", "a@b.c", "@", "4111111111111111", "+1 (743) 555-3824", ".", "-", " ", "5", "x"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(10_000)]
    for t in texts:
        assert personal_data.base_spans(t) == plain_spans(t)


def test_labels_agree_over_a_document():
    text = "call +1 (743) 555-3824 or later 743-555-3824 x"
    base, both = personal_data.find(text)
    assert [k for k, _, _ in base] == ["phone"] and [text[a:b] for _, a, b in both] == ["+1 (743) 555-3824", "743-555-3824"]
    assert personal_data.find("the number 743-555-3824 alone")[1] == []
    assert personal_data.find(None) == personal_data.find("") == ([], [])


def test_added_spans_on_texts_unlike_the_lessons():
    """Precision and recall of the mentions that the field adds, on sentences of another make."""
    rng = random.Random(77)
    hit = said = true = 0
    for _ in range(400):
        a, b, c = rng.randint(200, 989), rng.randint(200, 989), rng.randint(1000, 9999)
        bare = rng.choice([f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}{b}{c}"])
        about = rng.choice(["Dr. Meyer sees patients on Monday", "The annual meeting took place", "Le magasin est ouvert", "We ship every day"])
        if rng.random() < 0.5:
            text = f"{about}; reach us at +1 ({a}) {b}-{c}. {about} and again {bare} please. " + f"{about} or {bare}. " * rng.randint(0, 6)
            want = {m.span() for m in re.finditer(re.escape(bare), text)}
        else:
            text = f"{about}; see order {bare} or page {rng.randint(1, 99)}, batch {rng.randint(10**7, 10**9)}. {about}."
            want = set()
        base, both = personal_data.find(text)
        added = {(s, e) for _, s, e in both if (s, e) not in {(s, e) for _, s, e in base}}
        hit, said, true = hit + len(added & want), said + len(added), true + len(want)
    assert hit >= 0.95 * said and hit >= 0.95 * true, (hit / said, hit / true)


def test_personal_data_of_odd_tables(spark):
    rows = [(1, "mail a@b.c or 10.0.0.1", "x"), (1, "mail a@b.c or 10.0.0.1", "x"), (None, "+1 (743) 555-3824", "y"), (2, None, "z"), (3, "", None), (4, "5 " * 60_000 + "a@b.c", "l")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_email string").withColumnRenamed("n_email", "spans")
    out = personal_data.digest(df).collect()
    assert len(out) == 6 and [r["n_email"] for r in out if r["doc_id"] == 1] == [1, 1] and [r["n_ip"] for r in out if r["doc_id"] == 1] == [1, 1]
    assert {r["doc_id"]: r["spans"] for r in out if r["doc_id"] in (None, 2, 3, 4)} == {None: "phone:0:17", 2: "", 3: "", 4: "email:120000:120005"}
    assert personal_data.digest(df.limit(0)).count() == 0


def test_round_trips_of_odd_tables(spark):
    import hashlib

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    rows = [(i, t, "x") for i, t in enumerate([*odd_texts(200), None])] + [(1, "  a  b", "x"), (None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    want = []
    for i, t, _ in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    out = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trips(df, path).collect()]
    assert sorted(out) == sorted(want)
    assert bpe.round_trips(df.limit(0), path).count() == 0


def test_pieces_equal_the_library(spark):
    import zlib

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs = Tokenizer.from_file(path)
    rows = [(i, t, "x", "y") for i, t in enumerate([*odd_texts(150), None, "long " * 9000])]
    df = spark.createDataFrame(rows, "doc_id int, text string, piece string, length string")
    want = []
    for i, t, *_ in rows:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.append((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    out = packing.pack(df, path).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


def test_labels_agree_over_many_repeats():
    bare, exact = "then the number 415 555 1234 again with words between here; ", "call +1 (415) 555-1234 now and wait a while; "
    text = "so it is " + bare * 50 + exact + bare * 50
    base, both = personal_data.find(text)
    assert len(base) == 1 and [k for k, _, _ in both] == ["phone"] * 101
    assert personal_data.find("so it is " + bare * 100)[1] == []


def test_messages_reach_the_end_of_a_long_chain():
    nodes, pairs = np.zeros((61, 2)), np.array([(i, i + 1) for i in range(60)])
    nodes[0] = [0.0, 30.0]
    pot = np.broadcast_to(np.log([[0.999, 0.001], [0.001, 0.999]]), (60, 2, 2))
    assert np.isclose(personal_data.beliefs(nodes, pairs, pot)[60, 1], (1 + 0.998**60) / 2, atol=1e-3)


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(1)
    nodes, pairs = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    pot = rng.normal(size=(3, 3, 3))
    want = np.zeros((4, 3))
    for x in np.ndindex(3, 3, 3, 3):
        p = np.exp(sum(nodes[i, x[i]] for i in range(4)) + sum(pot[e, x[a], x[b]] for e, (a, b) in enumerate(pairs)))
        for i in range(4):
            want[i, x[i]] += p
    assert np.allclose(personal_data.beliefs(nodes, pairs, pot), want / want.sum(1, keepdims=True), atol=1e-3)


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[600:1100] = x[600]  # a third of the rows is one vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] * 16, 0), (9300, [None] * 16, 0), (9400, [], 0), (9500, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = nearest.search(df).collect()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        hit += len({m[1] for m in mine} & set(order))
        assert all(abs(m[2] - d[m[1]]) < 1e-12 for m in mine)
    assert hit >= 0.95 * 150
    assert not any(r["query_id"] >= 9000 for r in out)
    assert nearest.search(df.limit(0)).count() == 0


def exact_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    rows = [(0, ""), (1, None), (2, " \t"), (3, "one"), (4, "ONE"), (5, "two"), (6, "É x"), (7, "é x")]
    for i in range(10, 150):  # one family whose members differ by a few words
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 220):  # a passage that many share
        rows.append((i, " ".join(base[:20] + [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(2, 40))])))
    rows += [(i, "copy of one text") for i in range(220, 260)]
    want = exact_components(rows)
    got = near_duplicates.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    odd = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    out = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_duplicates.group(odd).collect())
    assert out == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert sorted(str(r["doc_id"]) for r in near_duplicates.keep_one(odd).collect()) == ["1", "None"]
    assert near_duplicates.group(odd.limit(0)).count() == near_duplicates.keep_one(odd.limit(0)).count() == 0


def test_one_id_on_several_texts_is_one_node(spark):
    words = [f"w{i}" for i in range(60)]
    one, two, three = (" ".join(words[i : i + 20]) for i in (0, 20, 40))
    rows = [(1, one, "x"), (1, two, "y"), (2, one + " z", "x"), (3, two + " z", "x"), (0, three, "x"), (9, three, "x"), (9, "other words here", "x"), (10, "other words here", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.group(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0, 10: 0, None: None}
    left = near_duplicates.keep_one(df)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["0", "1", "None"]


def test_sets_of_very_many_short_texts():
    texts = [f"a{i} b{i}" for i in range(70_000)]
    sets, counts = near_duplicates.shingle_sets(texts)
    assert counts.tolist() == [1] * 70_000 and len(set(sets.tolist())) == 70_000
    assert max(b - a for a, b in arrays.cuts(texts)) <= 1 << 15


def test_many_short_documents_with_one_passage(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(2, 14)))) for i in range(400)]
    got = near_duplicates.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == exact_components(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(1000, 2000 + i) for i in range(200)] + [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


def test_signature_estimates_similarity():
    a = [f"w{i}" for i in range(400)]
    b = a[:360] + [f"x{i}" for i in range(40)]
    sets, counts = near_duplicates.shingle_sets([" ".join(a), " ".join(b)])
    signature = near_duplicates.super_minhash(sets, counts)
    assert abs((signature[0] == signature[1]).mean() - 359 / 439) < 0.1


def test_hashes_of_runs_do_not_depend_on_their_place():
    codes, at = arrays.code_points(["ab cd ab", "cd"])
    starts, ends = arrays.runs(arrays.is_word(codes))
    h = arrays.run_hashes(arrays.prefix_hashes(codes), starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_plain_words_are_encoded_by_merges_alone():
    made = packing.LowerCodec(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    words += ["".join(rng.choice("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'\\") for _ in range(rng.randint(1, 5))) for _ in range(1000)]
    words += [*"0123456789", "'s", "'ll", "é", "straße", "\x00", "\x7f", "日本", "ā"]
    expected = [e.ids for e in made.tokenizer.encode_batch(words, add_special_tokens=False)]
    asked = []

    class Recorder:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, some, **named):
            asked.extend(some)
            return self.inner.encode_batch_fast(some, **named)

    made.tokenizer = Recorder(made.tokenizer)
    got = made.encode([" ".join(words)])[0].tolist()
    assert got == [i for ids in expected for i in ids]
    assert asked and not any(w.isascii() and w.isprintable() for w in asked)
