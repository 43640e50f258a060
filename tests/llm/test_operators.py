import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import DataFrameWriter
from tokenizers import Tokenizer

from codeloom.llm import byte_bpe, language_model, mixing, multiset_hash, pretokens, quality, queries, simhash, token_counts, top_k, toxicity, url_filter
from codeloom.llm.common import words

LONG = "word " * 30_000
TEXTS = [None, "", " \n\t ", "one", "one two", "One two three", "one TWO three", "a b c d e\n\nf g", "don't stop  now \n ok", "ünï 文字 ☃ x٣y", "x\x1cy\x85z   q", "<|endoftext|> a", "aaaaaaa" * 90, "  lead", "trail  ", LONG]


def documents(spark, texts=TEXTS):
    rows = [(k, t, "en", ("s1", "s2", None)[k % 3], k, "clash", 1.0) for k, t in enumerate(texts)] + [(3, "one", "en", "s1", 3, "clash", 1.0), (None, "one two", "en", "s2", 7, "clash", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double")


def empty(spark):
    return documents(spark).limit(0)


def test_url_filter(spark):
    urls = ["http://A.example.net/en/1", "https://x.net/de/", "http://q.net?x", "ftp://b.org/fr/x#y", "nothing", None, "http://example.com/de/2?a", "http://badexample.com/de/2", "http://good.example.com/en/5"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    model = url_filter.train(*url_filter.sample_labels(400))
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, queries.RULES, model).collect()}
    assert [(rows[k].host, rows[k].path, rows[k].rule) for k in range(9)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("x.net", "/de/", "net/"), ("q.net", "", None), ("b.org", "/fr/x", "org/fr/"), ("", "", None), ("", "", None), ("example.com", "/de/2", "example.com/de/"), ("badexample.com", "/de/2", None),
        ("good.example.com", "/en/5", None),
    ]
    assert rows[0].verdict == "allow" and rows[1].verdict == "block" and rows[8].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), queries.RULES, model).isEmpty()
    held, truth = url_filter.sample_labels(600, seed=99)
    x = np.array([url_filter.lexical(u, model.suffix_rates) for u in held], float)
    assert ((model.score(x) >= 0.5) == np.array(truth)).mean() > 0.95


def brute_components(bits):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def slow_fingerprint(text, k=3):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    bits = [slow_fingerprint(texts[i]) for i in ids]
    assert [found[i].fingerprint for i in ids] == [f"{b:016x}" for b in bits]
    assert [found[i].component_id for i in ids] == [ids[r] for r in brute_components(bits)]
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 2 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    assert simhash.near_duplicates(empty(spark)).isEmpty()


def test_simhash_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    bits = {0, 2**64 - 1, 3, 7}
    for b in base:  # fuller cells than DENSE, and chains of links
        for _ in range(70):
            bits.add(b ^ sum(1 << int(k) for k in rng.integers(0, 64, int(rng.integers(1, 4)))))
    bits = sorted(x - 2**64 if x >= 2**63 else x for x in bits)
    roots = dict.fromkeys(bits)
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components([b % 2**64 for b in bits])
    assert all(got.get(b, b) == bits[w] for b, w in zip(roots, want, strict=True))


def brute_similar(texts, shingle=5, similarity=0.8):
    """Component ids of all pairs at ``similarity`` or more, by the sets themselves."""
    ids, holders, sets = sorted(texts), {}, {}
    for i in ids:
        w = words(texts[i])
        sets[i] = {b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bare = [i for i in ids if not sets[i]]
    pairs = [(bare[0], i) for i in bare[1:]]
    for i in ids:
        shared = Counter(j for g in sets[i] for j in holders[g] if j < i)
        pairs += [(i, j) for j, n in shared.items() if n / (len(sets[i]) + len(sets[j]) - n) >= similarity]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_similar_is_what_all_pairs_give(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_similar({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_similar_of_large_groups_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng, rows = np.random.default_rng(5), []
    for _ in range(3):
        base = [f"w{x}" for x in rng.integers(0, 5000, 240)]
        for _ in range(60):  # a few words changed
            w = list(base)
            for at in rng.integers(0, 240, 2):
                w[at] = f"x{rng.integers(0, 10**9)}"
            rows.append(" ".join(w))
        for _ in range(30):  # a shared passage, but different documents
            rows.append(" ".join(base[:120] + [f"y{x}" for x in rng.integers(0, 10**9, 120)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == brute_similar(dict(enumerate(rows)))


def test_similar_of_large_groups_that_only_their_original_links(spark):
    rng, rows = np.random.default_rng(8), []
    base = [f"w{x}" for x in rng.integers(0, 10**6, 244)]
    for k in range(700):  # five edits each: 0.81 to the original, some 0.68 to one another
        w = list(base)
        for at in range(5) if k != 350 else ():
            w[10 + 48 * at + int(rng.integers(0, 30))] = f"x{rng.integers(0, 10**9)}"
        rows.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    # A copy shares no bucket with the original or a linked copy in some 0.2 % of cases; here none or very few.
    assert sum(c == 0 for c in got.values()) >= 698


def test_similar_tries_the_pairs_that_a_forest_displaced(spark, monkeypatch):
    """Texts near the threshold in one small bucket: a forest's failed edges hide true pairs."""
    rng, rows = np.random.default_rng(12), []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        for _ in range(20):
            w = list(base)
            for at in rng.choice(190, 3, replace=False):
                w[int(at)] = f"x{rng.integers(0, 10**9)}"
            rows.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # Every least hash in one bucket: what remains to be missed is the forest's part alone.
    sketched = simhash._sketched
    monkeypatch.setattr(simhash, "_sketched", lambda b, k: (m := sketched(b, k)) | {"bands": [[i // 20] for i in b["doc_id"]]})
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == brute_similar(dict(enumerate(rows)))


@pytest.mark.parametrize("side, side_bytes", [(2048, 1 << 23), (16, 1 << 23), (2048, 1 << 15)])
def test_similar_of_near_copies_under_the_threshold_makes_no_row_for_each_pair(spark, monkeypatch, side, side_bytes):
    """A group of which half is linked and the other half near to all, with a few pairs among it."""
    monkeypatch.setattr(simhash, "SIDE", side)
    monkeypatch.setattr(simhash, "SIDE_BYTES", side_bytes)
    rng, rows = np.random.default_rng(21), []
    base = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
    for k in range(240):  # one edit, or eight: 0.66 to 0.7 to the others
        w = list(base)
        for at in rng.choice(20, 1 if k % 2 else 8, replace=False):
            w[10 * int(at) + 3] = f"x{rng.integers(0, 10**9)}"
        rows.append(" ".join(w))
        if k % 24 == 0:
            rows.append(" ".join([*w[:-1], "end"]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # Every least hash in one bucket: all pairs stand there.
    sketched, cut, pairs = simhash._sketched, simhash.cut, []
    monkeypatch.setattr(simhash, "_sketched", lambda b, k: (m := sketched(b, k)) | {"bands": [[1] for _ in b["doc_id"]]})
    monkeypatch.setattr(simhash, "cut", lambda df: (made := cut(df), pairs.append(made.count()) if made.columns == ["u", "v"] else None)[0])
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    want = brute_similar(dict(enumerate(rows)))
    assert got == want and 100 < len(set(want.values())) < 130
    assert max(pairs) < 4 * len(rows)


def test_similar_rarely_misses_a_pair_at_the_threshold(spark):
    rng, rows = np.random.default_rng(6), []
    for _ in range(150):  # 11 of 100 five-word shingles changed on either side at most
        base = [f"w{x}" for x in rng.integers(0, 10**6, 104)]
        rows.append(" ".join(base))
        base[30], base[60] = "edit", "again"
        rows.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    linked = sum(r.component_id != r.doc_id for r in simhash.similar(docs).collect())
    assert linked >= 147


def test_keep_one(spark):
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert kept.where("doc_id is null").count() == 1 and simhash.keep_one(empty(spark)).isEmpty()


def test_keep_one_and_similar_judge_rows_that_share_an_id_by_their_texts(spark):
    words_of = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [("b", words_of(1), "p"), ("b", words_of(2), "q"), ("c", words_of(1), "r"), ("a", words_of(2) + " end", "s"), ("d", words_of(3), "t"), ("d", words_of(3), "u")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, text_id string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).orderBy("doc_id", "text").collect()]
    assert kept == [("a", words_of(2) + " end"), ("b", words_of(1)), ("d", words_of(3))]
    assert sorted(map(tuple, simhash.similar(docs).collect())) == [("a", "a"), ("b", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("d", "d")]


def test_similar_of_random_pairs_around_the_threshold(spark):
    rng, rows = np.random.default_rng(16), []
    for _ in range(200):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        w = list(base)
        for at in rng.choice(140, int(rng.integers(1, 7)), replace=False):
            w[int(at)] = f"x{rng.integers(0, 10**9)}"
        rows += [" ".join(base), " ".join(w)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_similar(dict(enumerate(rows)))
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want and 220 < len(set(want.values())) < 390


def test_language_model(spark):
    docs = documents(spark)
    counts, lexicon, model = language_model.fit(docs.where("doc_id <> 3 or doc_id is null"), steps=60)
    c = Counter()
    for r in docs.collect():
        if r.doc_id != 3:
            c.update([*words(r.text), b""])
    n, v = sum(c.values()), len(c)
    held = language_model.HELD
    for bound in (held, 3):
        language_model.HELD = bound
        try:
            rows = language_model.score(docs, counts, language_model.Lexicon.of(counts), model).collect()
        finally:
            language_model.HELD = held
        by = {r.doc_id: r for r in rows}
        for k, t in enumerate(TEXTS):
            tokens = [*words(t), b""]
            assert by[k].n_tokens == len(tokens) and by[k].n_known == sum(c[w] > 0 for w in tokens) and by[k].train_tokens == n
            assert by[k].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
            assert np.isfinite(by[k].score) and by[k].score < 0
    z = model.log_normalisers()
    u = np.full(language_model.CLASSES, 5)
    assert np.exp(model.log_probabilities(u, u + 1, np.arange(language_model.CLASSES), z)).sum() == pytest.approx(1, abs=1e-4)
    assert language_model.score(docs, *language_model.fit(empty(spark), steps=2)).count() == docs.count()
    assert language_model.score(empty(spark), counts, lexicon, model).isEmpty()


def test_language_model_tells_words_of_one_class_apart_by_context(spark):
    """Rare words that share their ending, each after another frequent word: the class alone can't tell which follows."""
    rng, texts = np.random.default_rng(4), []
    for _ in range(400):
        w = []
        for _ in range(60):
            k = int(rng.integers(0, 20))
            w += [f"lead{k}", f"r{k}x{int(rng.integers(0, 30))}zz"]
        texts.append(" ".join(w))
    texts += [f"fill{k} " * 100 for k in range(91)]  # with these, none of the rare words has a class of its own
    fitted = language_model.fit(documents(spark, texts))
    _, lexicon, model = fitted
    two = [" ".join(f"lead{k} r{(k + off) % 20}x{j}zz" for k in range(20) for j in range(30)) for off in (0, 7)]
    right, wrong = (r.score / r.n_tokens for r in language_model.score(spark.createDataFrame(list(enumerate(two)), "doc_id long, text string"), *fitted).orderBy("doc_id").collect())
    assert right > wrong + 0.1
    # The words of a class and what training lacks share all of its probability after any class.
    k = language_model.ending_class(b"r0x0zz")
    c = np.array([x >> language_model.PLACE for x in lexicon.held.values()])
    at = np.array([x & ((1 << language_model.PLACE) - 1) for x in lexicon.held.values()])
    own = c % language_model.CLASSES == k
    share = ((c[own] // language_model.CLASSES + 1)[:, None] * np.exp(lexicon.vectors[at[own]] @ model.before.T)).sum(0) + 1
    assert np.allclose(share / (lexicon.in_class.sum(0)[k] + 1), np.exp(model.log_shares[k]), rtol=1e-3)


def test_language_model_gathers_counts_by_slots(spark, monkeypatch):
    """What the words of many texts give is a row for each slot of keys, and for each rare word and the class before it."""
    rng = np.random.default_rng(3)
    texts = [None, "", *(" ".join(f"w{int(x)}" for x in rng.zipf(1.2, 80) % 10**7) + " \u00fcn\u00ef long" + "g" * 99 for _ in range(200))]
    monkeypatch.setattr(language_model, "HELD", 400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lexicon = language_model.Lexicon.of(language_model.word_counts(docs))
    found = language_model.gathered(docs, lexicon)
    names, cl = list(lexicon.held), language_model.CLASSES
    of = lambda w: (lexicon.held[w] >> language_model.PLACE) % cl if w in lexicon.held else language_model.ending_class(w)
    want, pairs = Counter(), Counter()
    for t in texts:
        row = [language_model.END] * 2 + [of(w) for w in words(t)] + [language_model.END]
        want.update((row[i - 2] * cl + row[i - 1]) * cl + row[i] for i in range(2, len(row)))
        pairs.update((w, row[i + 1]) for i, w in enumerate(words(t)) if row[i + 2] >= language_model.FREQUENT)
    want.update({cl**3 + names.index(w) * cl + v: n for (w, v), n in pairs.items() if w in lexicon.held})
    got = Counter()
    for r in language_model.summed(found.repartition(3)).collect():
        got.update(dict(zip((np.frombuffer(r["at"], np.uint16).astype(int) + r["slot"] * language_model.WIDE).tolist(), np.frombuffer(r["n"], np.int64).tolist(), strict=True)))
    rare = {(r.word.encode(), r.x % cl): r.x // cl for r in found.where("word is not null").collect()}
    assert got == want and rare == {k: n for k, n in pairs.items() if k[0] not in lexicon.held} and len(rare) > 100
    assert found.where("word is null").count() <= language_model.TRIPLES + 2 < len(want) / 10


@pytest.mark.parametrize("module, of, held, label, threshold, keeps", [(quality, 5, 0, "quality", 0.3, "predicted = 1"), (toxicity, 3, 1, "toxic", 0.7, "predicted = 0")])
def test_classifiers(spark, module, of, held, label, threshold, keeps):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    scored = module.score(docs, model)
    rows = scored.join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % of == held]
    assert np.mean([r.predicted == r[label] for r in out]) > 0.9
    assert all((r.score >= threshold) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    kept = module.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where(keeps).count()
    assert module.score(documents(spark), model).count() == len(TEXTS) + 2 and module.score(empty(spark), model).isEmpty()
    assert module.score(docs.limit(3), module.fit(docs, labels.limit(0))).count() == 3


def test_multiset_hash(spark):
    docs = documents(spark)
    rows = [r for r in multiset_hash.fingerprints(docs).collect()]
    order = sorted(docs.collect(), key=lambda r: (2**63 - 1 if r.doc_id is None else r.doc_id, r.text or ""))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint[:64]) for r in rows)
    want = Counter()
    for k, r in enumerate(order):
        t, n = r.text or "", order[(k + 1) % len(order)].text or ""
        cut = len(t) // 4
        lanes = [sum(xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)) & 0xFFFFFFFF for p in t.split("\n")) & 0xFFFFFFFF for i in range(8)]
        want[(r.doc_id, len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest(), "".join(f"{x:08x}" for x in lanes))] += 1
    assert got == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert multiset_hash.fingerprints(empty(spark)).isEmpty()
    two = spark.createDataFrame([(1, "a b.\nc d. e"), (2, "c d. e\na b.")], "doc_id long, text string")
    a, b = multiset_hash.fingerprints(two).orderBy("doc_id").collect()
    assert a.fingerprint == b.fingerprint and a.near_next == 1.0


def test_multiset_hash_likeness_is_that_of_its_lanes(spark):
    texts = ["a b. c d. e f", "a b. c d. x y", "same. " * 70_000, "same. " * 60_000, "", "one, two, three\nfour", "four\nthree, two, one"]
    rows = {r.doc_id: r for r in multiset_hash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def lanes(t):
        made = np.zeros(64)
        for piece in (p.strip(" ") for p in re.split(multiset_hash.PIECE, t)):
            if piece:
                made += [1 if xxhash.xxh64_intdigest(piece.encode(), 42) >> b & 1 else -1 for b in range(64)]
        return made

    order = [b for half in (0, 32) for b in range(half, half + 32)]
    for k, t in enumerate(texts):
        found = [int(rows[k].fingerprint[64 + 8 * i : 72 + 8 * i], 16) for i in range(64)]
        assert [x - 2**32 if x >= 2**31 else x for x in found] == lanes(t)[order].tolist()
        a, b = lanes(t), lanes(texts[(k + 1) % len(texts)])
        whole = (a @ a) + (b @ b)
        want = max(0.0, 1 - ((a - b) @ (a - b)) / whole) if whole else 0.0
        assert rows[k].near_next == pytest.approx(want)
    assert rows[2].near_next > 0.98 and rows[5].near_next == pytest.approx(1)


def test_multiset_hash_inserts_and_deletes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b\nc", "d\ne f", "a b\nc\nd\ne f")], "x string, y string, z string")
    lane = lambda c: multiset_hash.lanes(F.col(c))[0]
    r = df.select((multiset_hash.insert(lane("x"), lane("y"), 32) == lane("z")).alias("i"), (multiset_hash.delete(lane("z"), lane("y"), 32) == lane("x")).alias("d")).first()
    assert r.i and r.d


def test_token_counts(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in token_counts.count_tokens(documents(spark), P.path("byte_bpe_50k.json")).collect()}
    for k, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (rows[k].n_tokens, rows[k].n_bytes, rows[k].over_limit) == (n, len((text or "").encode()), n > 1024), text
    assert token_counts.count_tokens(empty(spark), P.path("byte_bpe_50k.json")).isEmpty()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    enc = library()
    rows = {r.doc_id: r for r in byte_bpe.encode(documents(spark), P.path("byte_bpe_50k.tiktoken")).collect()}
    for k, text in enumerate(TEXTS):
        ids = enc.encode_ordinary(text or "")
        assert rows[k].n_tokens == len(ids) and rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert rows[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode(empty(spark), P.path("byte_bpe_50k.tiktoken")).isEmpty()


def test_byte_bpe_against_the_library_on_random_texts():
    enc, rng = library(), np.random.default_rng(3)
    codec = byte_bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    alphabet = list("abc eETt'sll  \n\t.,!0129éßñ文字  \x1c☃") + ["the ", " and", "\r\n", "ing", "aaaa", "    ", "🙂"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 400)))) for _ in range(300)] + ["ab" * 3000, "\n" * 700, "é" * 900]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_of_long_pieces_is_that_of_the_library():
    enc, rng = library(), np.random.default_rng(9)
    codec = byte_bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    texts = ["".join(rng.choice(["ing", "the", "tion", "a", "b", "er", "qu", "zz", "é", "ab"], n)) for n in (200, 3_000, 40_000)] + ["a" * 257, "=" * 20_000, "\n" * 9_001, "x" * 300_000]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    assert max(map(len, [*codec.known, *codec.parts]), default=0) <= 64


def test_byte_bpe_gives_the_ids_themselves(spark):
    enc = library()
    docs = documents(spark).withColumnRenamed("score", "ids")
    rows = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), ids=True)
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "fingerprint", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    by = {r.doc_id: r for r in rows.collect()}
    assert all(by[k].ids == enc.encode_ordinary(t or "") and by[k].fingerprint == "clash" for k, t in enumerate(TEXTS) if k != 3)


def test_pieces_by_chunks_are_those_of_the_text():
    rng = np.random.default_rng(5)
    for _ in range(500):
        text = "".join(rng.choice(list("ab 1.'s\n\t "), 30))
        if parted := pretokens.chunks(text):
            assert pretokens.pieces(parted[0]) + [p for c in parted[1] for p in pretokens.pieces(" " + c)] == pretokens.pieces(text)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(0, 0.15, 16)] for _ in range(900)]
    vectors[7:12] = [vectors[0]] * 5
    rows = [(k, v, "clash") for k, v in enumerate(vectors)] + [(1000, None, ""), (1020, [None, 1.0], ""), (1040, [float("nan")] * 16, ""), (1060, [0.5], "")]
    found = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), k=5).collect()
    ints = {k: [int(np.floor(64 * x)) for x in v] for k, v in enumerate(vectors)} | {1060: [32]}
    for q in [k for k in ints if k % 20 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=False)), k) for k, v in ints.items() if k != q))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]
    assert {r.query_id for r in found} == {k for k in ints if k % 20 == 0}
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score string")
    assert top_k.top_k(few).count() == 2 and top_k.top_k(few.limit(0)).isEmpty()


def test_top_k_takes_every_row_of_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.25, 1.0]), (None, [0.75, 0.0]), (20, [0.1, 0.1]), (20, [0.1, 0.1])]
    found = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    first = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == 0)
    assert first == [(1, None, 64 * 48), (2, 1, 64 * 32), (3, 1, 64 * 16), (4, 20, 64 * 6), (5, 20, 64 * 6)]
    assert sorted(r.rank for r in found if r.query_id == 20) == sorted([*range(1, 6)] * 2)


def test_mixing(spark):
    assert mixing.targets({"a": 10, "b": 10, None: 10}) == {"a": 5.0, "b": 10.0, None: 15.0}
    assert mixing.targets({"a": 100, "b": 1, "c": 1}) == {"a": 96.0, "b": 3.0, "c": 3.0}
    docs = spark.createDataFrame([(k, "w " * (k % 37 + 1), f"s{min(k % 9, 4)}") for k in range(4000)] + [(4001, None, None)], "doc_id long, text string, source string")
    rows, again = (sorted(map(tuple, mixing.mix(docs).collect()), key=lambda r: r[0]) for _ in range(2))
    assert rows == again and len(rows) == 4001
    by = Counter()
    goal = {}
    for (doc_id, size, _, target, taken, copies), source in zip(rows, [f"s{min(k % 9, 4)}" for k in range(4000)] + [None], strict=True):
        assert taken == size * copies and copies <= 3
        by[source] += taken
        goal[source] = target
    assert all(abs(by[s] - t) <= 0.02 * t + 40 for s, t in goal.items())
    assert mixing.mix(documents(spark)).count() == len(TEXTS) + 2 and mixing.mix(empty(spark)).isEmpty()
    assert mixing.resample(documents(spark)).columns == documents(spark).columns


def test_mixing_plan_is_that_of_fractions(spark):
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (7, 50), (300, 10**6), (40, 2)):
        sizes = {f"s{k:03}é": int(rng.integers(0, top)) for k in range(n)} | {None: 7, "": 0}
        rows = spark.createDataFrame([(s, 1, w) for s, w in sizes.items()], "source string, n long, words long")
        assert {r.source: r.target for r in mixing.plan(rows).collect()} == mixing.targets(sizes)


def test_mixing_takes_rows_not_ids(spark):
    rows = [(1, "a b", "s", "x"), (1, "other text here", "s", "y")] + [(None, f"n{k} m", "t", "z") for k in range(600)] + [(7, "same row", "u", "z")] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    taken = Counter(r.text for r in mixing.resample(docs.withColumnRenamed("copies", "_copies"), most=3).collect())
    made = mixing.mix(docs).collect()
    assert len(made) == len(rows) and max(taken.values()) <= 3 * 700 and set(taken) <= {r[1] for r in rows}
    goal = mixing.targets({"s": 5, "t": 1200, "u": 1400})
    for source, of in (("s", ("a b", "other text here")), ("t", [r[1] for r in rows[2:602]]), ("u", ("same row",))):
        assert abs(sum(taken[t] * len(t.split()) for t in of) - goal[source]) <= 6


def test_mixing_takes_each_document_as_often_as_it_is_due(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 5 + 1), f"s{k % 2}") for k in range(1200)], "doc_id long, text string, source string")
    n, seen = 24, Counter()
    for seed in range(n):
        for r in mixing.mix(docs, seed=seed).collect():
            seen[r.doc_id] += r.copies
    due = {s: t / 1800 for s, t in mixing.targets({0: 1800, 1: 1800}).items()}
    for s in (0, 1):
        mean = [seen[k] / n for k in range(1200) if k % 2 == s]
        part = due[s] % 1
        assert np.mean(mean) == pytest.approx(due[s], abs=0.01)
        # No document is favoured: the spread of the means is that of independent seeds.
        assert np.var(mean) == pytest.approx(part * (1 - part) / n, rel=0.25)


def test_factorization_machine_is_the_sum_over_pairs_and_learns_interactions(spark):
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)), 0.3)
    at, x = np.array([1, 4, 5, 8]), rng.random(4)
    pairs = sum(float(m.factor[at[i]] @ m.factor[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(at, x) == pytest.approx(0.3 + float(m.weight[at] @ x) + pairs)
    for label in (lambda a, b: a != b, lambda a, b: a and b):
        rows = []
        for i in range(900):
            a, b = (int(v) for v in rng.integers(0, 2, 2))
            w = [f"f{v}" for v in rng.integers(0, 400, 20)] + ["insult"] * a + ["group"] * b
            rng.shuffle(w)
            rows.append((i, " ".join(w), int(label(a, b))))
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        s = toxicity.Scorer(toxicity.fit(df, df))
        for a in (0, 1):
            for b in (0, 1):
                assert (s.score("f1 f2" + " insult" * a + " group" * b) > 0.5) == bool(label(a, b))


def test_follow_the_regularised_leader_is_the_scalar_rule():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(20, 5, replace=False)).astype(np.int32), rng.random(5).astype(np.float32), int(rng.integers(0, 2))) for _ in range(40)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n, zb, nb = [0.0] * 20, [0.0] * 20, 0.0, 0.0
    order = np.random.default_rng(3)
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    bias = 0.0
    for _ in range(4):
        for r in order.permutation(40):
            at, x, y = rows[r]
            g0 = 1 / (1 + np.exp(-(4 * sum(w(i) * v for i, v in zip(at, x, strict=True)) + bias))) - y
            for i, v in zip(at, x, strict=True):
                g, old = 4 * g0 * float(v), w(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * old
                n[i] += g * g
            zb += g0 - ((nb + g0 * g0) ** 0.5 - nb**0.5) / alpha * bias
            nb += g0 * g0
            bias = -zb / ((beta + nb**0.5) / alpha)
    made = quality.train(rows)
    dense = made.dense()
    assert [float(dense[i]) for i in range(20)] == pytest.approx([4 * w(i) for i in range(20)], abs=1e-4) and made.bias == pytest.approx(bias, abs=1e-5)


def test_trees_are_what_a_walk_gives_and_learn_from_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = url_filter.train(*url_filter.labelled(pages, queries.RULES))
    urls, truth = url_filter.labelled(pages, queries.RULES, held_out=True)
    x = np.array([url_filter.lexical(u, model.suffix_rates) for u in [*urls, None, "", "a" * 100_000]], float)

    def walk(row):
        total = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            for _ in range(model.depth):
                at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
            total += value[at - (2**model.depth - 1)]
        return 1 / (1 + np.exp(-total))

    score = model.score(x)
    assert score.tolist() == pytest.approx([walk(r) for r in x])
    assert ((score[: len(urls)] >= 0.5) == np.array(truth)).mean() > 0.9 and len(urls) > 50


def test_rule_book_is_what_all_rules_give():
    rng = np.random.default_rng(5)
    names = ["a", "b", "com", "a.com", "b.a.com", "x.b.a.com", "aa.com", ""]
    rules = [url_filter.Rule(("block", "allow")[int(rng.integers(2))], str(rng.choice(names[:6])), str(rng.choice(["/", "/a", "/a/b/", "/b/"]))) for _ in range(12)]
    book = url_filter.RuleBook(rules)
    for host in names:
        for path in ("", "/", "/a", "/a/b/c", "/b/x", "/c"):
            fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            got = book.match(host, path)
            assert (got and got.text) == (min(fits, key=lambda r: (-len(r.text), r.text)).text if fits else None)


def test_url_filter_takes_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (3, "x" * 200_000)], "page_id int, url string")
    model = url_filter.train(["http://a.net/x", None, "http://b.com/"], [1, 0, 0])
    rows = url_filter.filter_urls(pages, queries.RULES, model).collect()
    assert sorted((str(r.page_id), r.rule) for r in rows) == [("1", "net/"), ("1", "net/"), ("2", None), ("3", None), ("None", "net/")]


def test_pipeline(spark):
    """Every stage against a plain version of its own: the classifiers' scores, all pairs, the mix's bounds, the library."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: Counter(map(tuple, df.collect()))
    whole = rows(docs)
    texts_of = lambda found: {r[0]: r[1] for r in found}

    kept = stages["quality_filter"](spark, docs, sf)
    scores = dict(zip(texts_of(whole), quality.score_texts(list(texts_of(whole).values()), (w := quality.fit(docs, labels)).dense(), w.bias), strict=True))
    assert kept.columns == columns and rows(kept) == Counter({r: n for r, n in whole.items() if scores[r[0]] >= 0.3})

    clean, machine = stages["toxicity_filter"](spark, kept, sf), toxicity.fit(kept, labels)
    scorer = toxicity.Scorer(machine)
    assert clean.columns == columns and rows(clean) == Counter({r: n for r, n in rows(kept).items() if scorer.score(r[1]) < 0.7})

    single = stages["near_dedup"](spark, clean, sf)
    groups = brute_similar(texts_of(rows(clean)))
    assert single.columns == columns and rows(single) == Counter({r: 1 for r in rows(clean) if groups[r[0]] == r[0]})

    mixed = stages["mix_sources"](spark, single, sf)
    sizes = Counter()
    for r in rows(single):
        sizes[r[3]] += len(words(r[1]))
    goal, taken = mixing.targets(dict(sizes)), Counter()
    for r, n in rows(mixed).items():
        assert n <= 3 and r in rows(single)
        taken[r[3]] += n * len(words(r[1]))
    longest = max(len(words(r[1])) for r in rows(single))
    assert mixed.columns == columns and all(abs(taken[s] - t) <= longest for s, t in goal.items())

    encoded, enc = stages["encode"](spark, mixed, sf).collect(), library()
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded) == Counter({(r[0], tuple(enc.encode_ordinary(r[1] or ""))): n for r, n in rows(mixed).items()})
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).drop("ids").collect())) == Counter(tuple(v for k, v in r.asDict().items() if k != "ids") for r in encoded)


def test_pipeline_takes_nulls_clashes_and_no_labels(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark).withColumnsRenamed({"fingerprint": "text_id", "score": "copies"}), documents(spark).withColumnsRenamed({"fingerprint": "row", "score": "_copies"}).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert name == "encode" or docs.columns == columns
        assert "ids" in docs.columns and docs.count() >= 0


def test_top_k_shards_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    for rows in (np.full((300, 2), 3), rng.integers(-40, 40, (3000, 48)), rng.integers(-1, 2, (700, 5))):  # equal rows: no term has a range
        n, ids, asked = len(rows), rng.permutation(len(rows)), np.arange(0, len(rows), 17)
        places = np.arange(n)
        _, found, scores = top_k.search_shard(asked, rows[asked], ids, places, rows, 20)
        want = [sorted((-int(rows[q] @ rows[r]), int(ids[r])) for r in range(n) if r != q)[:20] for q in asked]
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == [x for w in want for x in w]


def test_linking_broadcasts_nothing_for_its_estimated_size(spark, monkeypatch):
    key, seen, write = "spark.sql.autoBroadcastJoinThreshold", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(key)), write(self, *a, **b))[1])
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(k, f"one two three four {k % 3}") for k in range(9)], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1, 2] * 3
    assert len(seen) > 3 and set(seen) == {"-1"} and spark.conf.get(key) == before


def test_classifiers_train_on_an_executor_and_plan_without_long_lists(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"plain w{k % 7} {'insult group' if k % 3 == 0 else 'word'}") for k in range(90)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic", "int(doc_id % 3 = 0) as quality")

    def here(*a, **b):
        raise AssertionError("in the driver")

    monkeypatch.setattr(type(docs.text), "isin", here)
    for module in (quality, toxicity):
        with monkeypatch.context() as m:
            m.setattr(module, "train", here)
            made = module.fit(docs, labels)
        margins = [float(module.score_texts([t], made.dense(), made.bias)[0]) if module is quality else module.Scorer(made).score(t) for t in ("plain insult group", "plain word")]
        assert margins[0] > 0.5 > margins[1]
        assert module.fit(docs.limit(0), labels).bias == 0.0


def test_among_is_what_a_loop_keeps(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("codeloom.llm.common.SLICE", 256)
    rng, tried = np.random.default_rng(7), np.array([2, 3, 11, 12], np.int32)
    found = [[{"term": int(t), "n": int(n)} for t, n in zip(rng.permutation(14)[: rng.integers(0, 9)], rng.integers(1, 5, 9))] for _ in range(50)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([0] * 50, pa.int32()), pa.array(found, pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())])))], names=["doc_id", "label", "found"])
    parts = list(toxicity.among(tried, iter([rows.slice(3, 40), rows.slice(43)])))
    assert len(parts) > 4
    got = [(r["doc_id"], list(zip(r["term"], r["n"], strict=True))) for p in parts for r in p.to_pylist()]
    assert got == [(k, [(e["term"], e["n"]) for e in found[k] if e["term"] in tried]) for k in range(3, 50)]
