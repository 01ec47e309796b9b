"""Operators on documents against brute force, with nulls, ties, empty tables and clashing columns."""

import hashlib
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindle.llm import common, fingerprints, language, minhash, mixing, packing, quality, secrets, substrings

from . import brute


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def pairs(corpus):
    return [(r[0], r[1]) for r in corpus]


# --- 1 ---


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(documents, corpus, batches):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted(brute.substrings(pairs(corpus)), key=str)
    assert got(substrings.deduplicate(documents, batches=batches), *names) == want
    assert any(r[2] for r in want)


def test_substrings_small_windows(documents, corpus):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substrings.deduplicate(documents, window=12, anchor=3), *names) == sorted(brute.substrings(pairs(corpus), 12), key=str)


def test_substrings_texts(documents):
    for r in substrings.deduplicate(documents, texts=True).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]


def test_index_keeps_what_runs_hold(documents, spark):
    scratch = common.Scratch(spark, "test")
    found = scratch.save(substrings.segments(common.take(documents, doc_id="long", text="string").selectExpr("doc_id", "xxhash64(text) t", "text")), "s")
    index = substrings.Index(scratch, fanout=2)
    for low in range(0, 400, 100):
        index.ingest(found.where(f"doc >= {low} and doc < {low + 100}"))
    index.compact()
    assert len(index.runs) == 1 and index.runs[0][0] == 2  # four runs became one, two levels up
    assert index.runs[0][2].count() == found.where("doc < 400").select("m", "s1", "s2", "n").distinct().count()


def test_index_lasts_from_batch_to_batch(documents, corpus, spark, tmp_path):
    """Each call holds a batch against the runs of earlier ones; together they give what one call over all gives."""
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    folder, found, before = str(tmp_path / "it's an index"), [], "false"
    for low, high in ((0, 100), (100, 200), (200, 260), (260, 2000)):
        batch = documents.where(f"doc_id >= {low} and doc_id < {high}")
        out = substrings.deduplicate(batch, batches=1, index=folder, history=documents.where(before) if low else None)
        found += got(out, *names)
        before = f"doc_id < {high}"
    assert sorted(found, key=str) == [r for r in sorted(brute.substrings(pairs(corpus)), key=str) if r[0] is not None]
    kept = substrings.Index.open(common.Scratch(spark, "test"), folder, substrings.WINDOW, substrings.ANCHOR)
    # runs are merged when the next batch comes: the first two by the third
    assert kept.newest == 1006 and kept.version == 4 and [(level, name) for level, name, _ in kept.runs] == [(1, "run2"), (0, "run3"), (0, "run4")]
    assert sorted(kept.lasting.names()) == ["manifest4", "run2", "run3", "run4"]
    # reopened runs are still dealt and sorted: a join by anchor takes them as they lie
    a, b = (r.select("m") for *_, r in kept.runs[1:])
    plan = a.hint("merge").join(b, "m")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    # a session that ends before its commit leaves the index as it was, and the next one takes its place
    lost = common.take(spark.createDataFrame([(2000, "lost " * 80)], "doc_id long, text string"), doc_id="long", text="string").selectExpr("doc_id", "xxhash64(text) t", "text")
    kept.ingest(substrings.segments(lost))
    again = spark.createDataFrame([(2000, "found " * 80), (2001, "lost " * 80)], "doc_id long, text string")
    assert got(substrings.deduplicate(again, index=folder, history=documents), "doc_id", "n_removed") == [(2000, 0), (2001, 0)]
    assert substrings.Index.open(common.Scratch(spark, "test"), folder, substrings.WINDOW, substrings.ANCHOR).newest == 2001
    assert substrings.deduplicate(documents.limit(0), index=folder, history=documents).count() == 0
    with pytest.raises(ValueError, match="does not come after"):
        substrings.deduplicate(documents, index=folder, history=documents)
    with pytest.raises(ValueError, match="history"):
        substrings.deduplicate(documents, index=folder)
    with pytest.raises(ValueError, match="other windows"):
        substrings.deduplicate(documents, window=20, index=folder, history=documents)


def thue_morse(n):
    """A word of n letters and its complement: polynomials in an odd number, modulo a power of two, take them for equal."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_break_polynomial_hashes_are_told_apart(spark):
    same, (x, y) = " ".join(f"w{i}" for i in range(49)), thue_morse(2048)
    many, swapped = (" ".join("uv"[c == "b"] for c in w) for w in (x, y))
    rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, x), (4, y), (5, many), (6, swapped)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(rows), key=str)
    assert got(substrings.deduplicate(df), "doc_id", "n_removed")[:2] == [(1, 0), (2, 0)]
    assert got(minhash.classes(df), "doc_id", "class_id") == brute.classes(rows)
    found = dict(got(minhash.classes(df), "doc_id", "class_id"))
    assert found[3] == 3 and found[4] == 4


# --- 2 ---


def test_classes(documents, corpus):
    want = brute.classes(pairs(corpus))
    assert got(minhash.classes(documents), "doc_id", "class_id") == want
    assert any(b is not None and a != b for a, b in want)


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.integers(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{i}_{j}" for j in range(50))) for i in range(20)]
    out = dict(got(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id"))
    assert {out[i] for i in range(150)} == {0} and all(out[1000 + i] == 1000 + i for i in range(20))


def test_chains_are_one_class(spark):
    """Neighbours are alike, ends are not; later rounds must find what the first centre did not."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 6 : i * 6 + 200])) for i in range(20)]
    assert got(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id") == brute.classes(rows)


def test_every_text_of_a_doc_id_is_compared(spark):
    """A near copy of a doc_id's second text, and an exact copy of another's, belong to its class."""
    of = lambda c, *other: " ".join(other[0] if other and i == 60 else f"{c}{i}" for i in range(120))
    rows = [(5, of("a")), (5, of("b")), (7, of("b", "x")), (9, of("c")), (9, of("d")), (9, of("d")), (9, None), (3, of("d")), (8, of("a", "y")), (4, of("z")), (11, of("c", "q")), (None, of("b")), (12, None), (12, "")]
    out = got(minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id")
    want = {5: 5, 7: 5, 8: 5, 9: 3, 3: 3, 11: 3, 4: 4, 12: 12, None: None}
    assert out == sorted(((d, want[d]) for d, _ in rows), key=str)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    a = {v: int(c) for v, c in zip(values[:200], rng.integers(1, 9, 200))}
    b = {v: int(c) for v, c in zip(values[60:], rng.integers(1, 9, 240))}
    flat = [np.concatenate(x) for x in zip(*[(np.full(len(d), i), np.array(list(d), np.uint64), np.array(list(d.values()), float)) for i, d in enumerate((a, b))])]
    held = minhash.probminhash(*flat, 2, 4000)
    want = brute.probability_jaccard(Counter(a), Counter(b))
    assert abs((held[0] == held[1]).mean() - want) < 0.03
    exact = minhash.similarity(*[(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], float)) for d in (a, b)])
    assert abs(exact - want) < 1e-9


def test_one_of_each_class_stays(documents, corpus):
    kept = got(minhash.deduplicated(documents), "doc_id")
    want = {c for _, c in brute.classes(pairs(corpus)) if c is not None}
    assert Counter(kept) == Counter([(d,) for d in want] + [(None,)])


# --- 3 ---


def test_secrets(documents, corpus):
    rows = got(secrets.scan(documents), "doc_id", "base_sha256", "n_assign", "n_access", "n_hex")
    want = []
    for d, t in pairs(corpus):
        spans = brute.base_spans(t)
        kinds = Counter(s.split(":")[0] for s in spans.split(","))
        want.append((d, hashlib.sha256(spans.encode()).hexdigest(), kinds["assign"], kinds["access"], kinds["hex"]))
    assert rows == sorted(want, key=str) and any(r[2] for r in rows)


def test_failing_matches_are_used_up(spark):
    texts = ['secret:"token":abcdefghij', "password=a password=abcdefgh", "AKIA AKIAABC AKIA0123456789AB", "x" + "0a" * 16 + "g" + "0" * 31, "ＴＯＫＥＮ = abcdefgh ſecret=abcdefgh", "😀 api_key = 'abc.def-ghi='", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(secrets.scan(df), "doc_id", "base_sha256") == [(i, hashlib.sha256(brute.base_spans(t).encode()).hexdigest()) for i, t in enumerate(texts)]


def test_randomness_battery(spark):
    rng = np.random.default_rng(4)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ = ["".join(rng.choice(list(base64), 44)) for _ in range(40)] + ["".join(rng.choice(list("0123456789ABCDEF"), 48)) for _ in range(40)]
    plain = ["TheInternationalizationOfApplications2Handler", "configuration_of_the_environment_variables_v2", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef0123456789abcdef"[:31], "aaaaaaaaaaaaaaaaaaaaaaaaaa11", "https/www/example/com/path/to/some/Article2020", "donaudampfschifffahrtsgesellschaft"]
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(random_ + plain)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert sum(found[i] == f"random:7:{7 + len(t)}" for i, t in enumerate(random_)) >= 74
    assert all(not found[len(random_) + i] for i in range(len(plain)))


def test_random_tokens_of_every_encoding_are_found(spark):
    """Recall by encoding and length, alone and among tokens that are no secrets."""
    rng = np.random.default_rng(11)
    alphabets = {"hex": "0123456789ABCDEF", "base32": secrets.BASE32_ALPHABET, "base36": secrets.BASE36_ALPHABET, "upper36": secrets.BASE36_ALPHABET.upper(), "dashed": secrets.BASE36_ALPHABET}
    failing = " ".join(f"https/www/example/path/of/{w}/index" for w in "abcdefghij" * 2)
    rows, cells, n = [], [], 100
    for name, alphabet in alphabets.items():
        for size in (24, 32, 40):
            for other in (False, True):
                for _ in range(n):
                    t = "".join(rng.choice(list(alphabet), size))
                    t = "-".join(t[i : i + 8] for i in range(0, size, 8)) if name == "dashed" else t
                    rows.append((len(rows), f"{t} {failing if other else ''}"))
                    cells.append((name, size, other, len(t)))
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans").collect()}
    hits = Counter(c[:3] for i, c in enumerate(cells) if found[i] == f"random:0:{c[3]}")
    recall = {c[:3]: hits[c[:3]] / n for c in cells}
    least = {24: 0.72, 32: 0.85, 40: 0.93}
    assert not {c: r for c, r in recall.items() if r < least[c[1]]}, recall


def test_names_with_digits_are_no_secrets(spark):
    plain = ["how-to-build-a-house-in-2020-with-10-tips", "user2account3settings4page5index", "20zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "2-3-4-5-6-7-2-3-4-5-6-7-2", "-----------------------7", "MAXIMUM_NUMBER_OF_CONNECTIONS_2", "img_20200101_123456_holiday_photo", "-------------------A3---"]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).collect()
    assert not [(plain[r.doc_id], r.spans) for r in rows if r.spans]


def test_redaction(spark, documents):
    df = spark.createDataFrame([(1, "a token = abcdefgh! b", "k"), (2, None, "k"), (3, "plain", "k"), (4, "secret: " + "ab" * 20, "k")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert (rows[1].text, rows[2].text, rows[3].text, rows[4].text) == ("a [REDACTED]! b", None, "plain", "[REDACTED]") and rows[1].spans == "k"
    assert secrets.scan(secrets.redact(documents)).where("spans <> ''").count() == 0


def test_very_long_texts_and_many_secrets(spark):
    rng = np.random.default_rng(9)
    token = "".join(rng.choice(list(secrets.BASE64_ALPHABET), 200_000))
    many = " ".join(f"é password=abcdefg{i:x} {'AKIA' + 'Q' * 20 if i % 3 == 0 else 'token:short'}" for i in range(900))
    df = spark.createDataFrame([(1, f"ü {token} b"), (2, many), (3, "word " * 200_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert rows[1].spans == f"random:2:{2 + len(token)}" and rows[2].spans == brute.base_spans(many) and not rows[3].spans
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == "ü [REDACTED] b" and clean[3] == "word " * 200_000
    assert clean[2] == " ".join(f"é [REDACTED] {'[REDACTED]' if i % 3 == 0 else 'token:short'}" for i in range(900))


# --- 4 ---


def test_packing(documents, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(documents, capacity=256, open_bins=8).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, text in pairs(corpus):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in by_doc[d]), key=lambda r: r.piece)
        own = own[: len(own) // (2 if d == 1005 else 1)] if d != 1005 else own[::2]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 256 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256


@pytest.mark.parametrize("text", ["", "a", " a", "a  b", "a\n\nb ", "  x", "it's 12 o'clock…", "a\tb  c", "x y", "<|endoftext|>", "日本語 テキスト", "é\n \n z", "!!!  ???", "a\r\nb", "\x1c a"])
def test_tokens_are_those_of_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.Tokens().whole(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_one_id(spark):
    """As the library gives it by add_special_tokens=False alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "a\t<|endoftext|>\u00a0b <|endoftext", "plain"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_best_fit():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    bins = packing.BestFit(10, 1)
    assert [bins.place(n) for n in (5, 6, 3, 4)] == [(0, 0), (1, 0), (1, 6), (2, 0)]  # one bin may be open: each new one closes the last
    with pytest.raises(ValueError):
        bins.place(11)


def test_packing_wastes_little():
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.lognormal(5.7, 1.1, 20_000).astype(int) + 1, 2048)
    bins = packing.BestFit()
    for block in np.array_split(sizes, 2):
        for n in sorted(block, reverse=True):
            bins.place(int(n))
    assert bins.made <= 1.01 * sizes.sum() / 2048


# --- 6, 8 ---


def test_quality(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        w = ["".join(rng.choice(list("etaoinshr"), rng.integers(1, 9))) for _ in range(int(rng.integers(20, 120)))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good)))
    rows += [(9001, ""), (9002, None), (None, "null id")]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9003, None), (None, 1)], "doc_id long, quality int"))
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    held = [(found[i].predicted, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_quality_without_labels(spark, documents, empty):
    out = quality.classify(documents, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in out} == {0.5}
    assert quality.classify(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_isotonic():
    at, value = quality.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 0, 1, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1


def test_random_features_are_a_gaussian_kernel():
    m = quality.Model(np.zeros(5), np.ones(5))
    x = np.random.default_rng(1).normal(size=(40, 5))
    phi = m.phi(x)[:, : quality.FEATURES]
    width = quality.WIDTH * 5**0.5
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * width**2))
    assert np.abs(phi @ phi.T - want).mean() < 0.06


def test_language(spark):
    rng = np.random.default_rng(7)
    parts = {"en": ["th", "ing", "wh", "ed", "er"], "de": ["sch", "ung", "ei", "ß", "keit"], "es": ["ción", "ñ", "os", "ar", "ll"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang) for i in range(450) for lang in [sorted(parts)[i % 3]]]
    rows += [(9001, None, "en"), (9002, "12 -- 34", "en"), (9003, "", None), (9004, "schungei keit", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (9001, 9002, 9003)) and found[9004].lang_pred == "de"
    held = [found[i].lang_pred == lang for i, _, lang in rows[:450] if found[i].held_out]
    assert np.mean(held) >= 0.98 and all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)


def test_more_languages_than_a_hundred(spark):
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 115 * 6)]
    own = {f"l{k:03}": letters[6 * k : 6 * k + 6] for k in range(115)}
    rows = [(i, " ".join("".join(rng.choice(own[lang], 3)) for _ in range(30)), lang) for i in range(115 * 20) for lang in [f"l{i % 115:03}"]]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    predicted = {r.doc_id: r.lang_pred for r in found}
    assert len(set(predicted.values())) == 115 and np.mean([predicted[i] == lang for i, _, lang in rows]) >= 0.95


def test_language_without_any(spark, empty):
    assert language.identify(empty).count() == 0
    out = language.identify(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).first()
    assert (out.lang_pred, out.score) == ("und", 0.0)


# --- 7 ---


def test_mixing(documents, corpus):
    rows = mixing.mix(documents).collect()
    sizes = Counter()
    for _, text, _, source, _ in corpus:
        sizes[source] += len(brute.words(text))
    want = brute.mix_targets(sizes)
    of = {r[0]: r[3] for r in corpus}
    taken, largest = Counter(), Counter()
    for r in rows:
        s = of[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert len(rows) == len(corpus) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(documents).collect()), key=str)
    copies = Counter(r[0] for r in mixing.sample(documents).select("doc_id").collect())
    assert copies == Counter({k: v for k, v in Counter(x for r in rows for x in [r.doc_id] * (r.taken // r.size if r.size else 0)).items() if v})


def test_targets_meet_ceilings(spark):
    sizes = {"a": 100, "b": 1, "c": 2, "d": 0, None: 50, "é": 7}
    df = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    found = {r.source: r.target for r in df.collect()}
    want = brute.mix_targets(sizes)
    assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in want.items()}


def test_better_documents_come_first(spark):
    rows = [(i, ("good words here " if i % 2 else "#### %%%% &&&& ") * 10, "s") for i in range(400)] + [(1000 + i, "other text " * 20, "t") for i in range(400)]
    df = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9))
    taken = {r.doc_id: r.taken for r in df.collect()}
    assert sum(bool(taken[i]) for i in range(1, 400, 2)) > 3 * sum(bool(taken[i]) for i in range(0, 400, 2))


# --- 9 ---


def test_fingerprints(documents, corpus):
    rows = fingerprints.fingerprints(documents).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    ordered = sorted(pairs(corpus), key=key)
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    want, prints = [], defaultdict(set)
    for i, (d, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(fold(text) == fold(edited)), float(fold(text) == fold(after))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows), key=str) == sorted(want, key=str)
    texts = defaultdict(set)
    for d, t in pairs(corpus):
        texts[d].add(fold(t or ""))
    for r in rows:
        prints[r.fingerprint] |= texts[r.doc_id]
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len({t for v in texts.values() for t in v})


def test_equal_buckets_are_compared(documents, monkeypatch):
    """With a hash of two values, nearly all texts collide; fingerprints must still tell them apart."""
    from pyspark.sql import functions as F

    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents).collect()}
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: (F.pmod(F.xxhash64(c), F.lit(2)), F.lit(0).cast("long")))
    weak = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents).collect()}
    groups = lambda x: Counter(frozenset(d for d in x if x[d] == v) for v in set(x.values()))
    assert groups(plain) == groups(weak)


def test_many_documents_without_an_id_are_in_many_ranges(spark):
    rows = [(None if i % 3 else 5, f"text {i} " * (i % 7 + 1)) for i in range(300)] + [(9, "last one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fingerprints.followed(df).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    follows = {r.text: r.next for r in out}
    at, seen = "last one", []
    for _ in rows:
        seen.append(at := follows[at])
    ids = {t: d for d, t in rows}
    assert sorted(seen) == sorted(ids) and [ids[t] for t in seen] == [None] * 200 + [5] * 100 + [9]


def test_one_document_follows_itself(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


# --- all ---


@pytest.mark.parametrize("run", [substrings.deduplicate, minhash.classes, secrets.scan, packing.pack, mixing.mix, language.identify, fingerprints.fingerprints, minhash.deduplicated, secrets.redact, mixing.sample])
def test_empty_tables_and_clashing_names(run, documents, empty, clashing):
    assert run(empty).count() == 0
    out = run(clashing)
    plain = run(documents)
    if len(out.columns) == len(plain.columns):
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    else:  # these keep all columns
        assert out.columns == clashing.columns
        assert sorted(map(str, out.toDF(*[f"c{i}" for i in range(len(out.columns))]).select("c0", "c1").collect())) == sorted(map(str, plain.toDF("c0", "c1", "c2", "c3", "c4").select("c0", "c1").collect()))


