"""The ten operators against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import (
    bpe, bpe_codec, chat_format, components, decontaminate, langid, near_copies, quality_rules, secret_scan, simhash, suffix_dedup, token_counts, toxicity,
)
from chronoloom.llm import queries as llm_queries
from chronoloom.llm.common import read_table

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Les mots de la phrase " * 6000
TEXTS = [
    None, "", " \n\t ", "one", "Two words", "the same line\nthe same line\nthe same line", "password = hunter2hunter2 and more", "<|endoftext|> é 🙂 ß İ",
    LONG, LONG, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "token=abc", "x" * 150_000,
]


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empties, repeats, long texts, and extra columns with the names that operators use."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "fr", None if i % 5 == 0 else "src", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[8], (4, "another text under the id four", "en", "src", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["score", "fp", "row_key", "key", "content", "ids", "decoded", "spans", "n_tokens", "label", "n", "window", "words", "kept", "lang_pred", "item_id", "slots"]
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_token_counts_match_the_library(docs, messy):
    lib = library()
    for df in (docs, messy):
        known = sorted((r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text").collect())
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, bpe.default_vocabulary()).collect())
        want = []
        for i, t in known:
            n = len(lib.encode(t, add_special_tokens=False).ids)
            want.append((i, len(t.encode()), n, n > 2048))
        assert got == sorted(want)


def test_heap_and_scan_merge_alike():
    v = bpe.Vocabulary(bpe.file_bytes(bpe.default_vocabulary()))
    rng = np.random.default_rng(0)
    for _ in range(500):
        word = "".join(rng.choice(list("aeinorst"), rng.integers(1, 14)))
        symbols = v.start_symbols(word)
        assert bpe.count_by_heap(symbols, v.ranks) == len(bpe.merge_fragment(symbols, v.ranks))


def test_codec_matches_the_library_and_round_trips(docs, messy):
    lib = library()
    for df in (docs, messy):
        rows = bpe_codec.decode(bpe_codec.encode(df.drop("ids", "decoded"), bpe.default_vocabulary()), bpe.default_vocabulary()).collect()
        assert len(rows) == df.count()
        for r in rows:
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    r = bpe_codec.codec_digests(docs, bpe.default_vocabulary()).orderBy("doc_id").first()
    ids = lib.encode(docs.orderBy("doc_id").first()["text"], add_special_tokens=False).ids
    assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(ids)


def test_forced_boundaries_are_never_merged_over():
    v = bpe.Vocabulary(bpe.file_bytes(bpe.default_vocabulary()))
    codec = bpe.Codec(v)
    cut = codec.fragments("qzjthexq")
    assert "".join(cut) == "qzjthexq"
    for a, b in zip(cut, cut[1:]):
        assert not any(a[-1] + b[0] in t for t in v.ids)


def test_language_of_held_out_rows(spark, docs):
    rows = langid.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and not any(r["rejected"] for r in rows)


def test_language_of_awkward_rows(docs, messy):
    fitted = langid.fit(docs)
    rows = langid.identify_rows(messy, fitted).collect()
    assert len(rows) == messy.count()
    none = [r for r in rows if r["lang_pred"] == "und"]
    assert len(none) == 3 and all(r["score"] == 0.0 and r["rejected"] for r in none)
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.fit(messy.where("false"))
    assert {r["lang_pred"] for r in langid.identify_rows(messy, nothing).collect()} == {"und"}
    strange = docs.sparkSession.createDataFrame([(1, "Щука плывёт по реке быстро и тихо, а рыбак спит " * 20)], "doc_id long, text string")
    assert langid.identify_rows(strange, fitted).first()["rejected"]
    assert langid.keep_identified(messy, fitted).columns == messy.columns


def test_kneser_ney_sums_to_one():
    model = langid.CharModel.fit(["abba", "cab", "bac"], np.array([3, 2, 1]), 3)
    total = 0.0
    for c in "abc ":
        _, place, hashed = langid.ngrams(["ab" + c], 3)
        total += 2 ** model.score(place, hashed)[3] if c != " " else 2 ** model.score(*langid.ngrams(["ab"], 3)[1:])[3]
    assert 0.7 < total < 1.0  # the rest is left for unseen characters


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_simhash_matches_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in simhash.op2_simhash(spark, SF).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in rows.items()} == prints
    assert {i: r["component_id"] for i, r in rows.items()} == components_of(prints)


@pytest.mark.parametrize("bucket", [0, 2, 16])
def test_links_connect_all_within_two_bits(spark, bucket):
    rng = np.random.default_rng(bucket)
    centres = rng.integers(0, 1 << 63, 6, np.uint64)
    prints = {}
    for k in range(300):
        x = int(centres[k % 6])
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(b)
        prints[k] = x
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints.values()}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    labels = {r["node"]: r["label"] for r in components.connected_components(simhash.links(df, bucket=bucket)).collect()}
    groups = components_of(prints)
    for a in prints:
        for b in range(a):
            same = labels.get(signed[prints[a]], signed[prints[a]]) == labels.get(signed[prints[b]], signed[prints[b]])
            assert same == (groups[a] == groups[b])


def test_golay_neighbours_share_a_codeword():
    table, rng = simhash.golay_table(), np.random.default_rng(0)
    a = rng.integers(0, 1 << 23, 2000)
    b = a ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    assert all(set(x) & set(y) for x, y in zip(simhash.codeword_indices(a, table), simhash.codeword_indices(b, table)))


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[200] == got[199] == 199
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_awkward_rows(messy):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    kept = simhash.keep_one(messy)
    assert kept.columns == messy.columns and kept.count() == len({r["label"] for r in rows})
    assert kept.select("row_key").first()[0] == "own row_key"


def similarity(a, b):
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split())
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def similar_groups(texts):
    """The smallest id that chains of similarities of 0.8 or more reach, by all pairs."""
    grams = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    of = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            x, y = grams[i], grams[j]
            if j < i and of[i] != of[j] and (x == y or len(x & y) >= 0.8 * len(x | y)):
                a, b = of[i], of[j]
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    return of


@pytest.mark.parametrize("bucket", [2, 16])
def test_near_dedup_stage_takes_near_copies(spark, bucket):
    rng = np.random.default_rng(5)
    texts = [None, "", "two words", "Two  Words"]
    for n in (60, 200, 900, 900):
        base = [f"w{k}" for k in rng.integers(0, 4000, n)]
        for edits in (0, 1, 2, 4, 8, 20):
            words = list(base)
            for at in rng.integers(0, n, edits):
                words[int(at)] = f"x{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(words))
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df, lambda d: near_copies.near_copies(d, bucket=bucket)).collect()}
    assert kept == set(parent) and len(kept) < len(texts) - 8
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, SF).collect()} == set(parent)


@pytest.mark.parametrize("bucket", [2, 16])
def test_near_copies_of_a_crowded_band(spark, bucket):
    """Chains, stars and strangers that share shingles enough to meet in large bands lose no link."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(70):  # a drift: each text changes one more word of the one before, so ends differ while neighbours link
        texts.append(" ".join([f"d{at}" if at < k else w for at, w in enumerate(base)]))
    for _ in range(50):  # strangers: similar to many, near copies of few
        words = list(base)
        for at in rng.choice(200, int(rng.integers(3, 9)), replace=False):
            words[int(at)] = f"x{int(rng.integers(0, 10**6))}"
        texts.append(" ".join(words))
    parent = list(range(len(texts)))
    sets = [near_copies.shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in near_copies.near_copies(df, bucket=bucket).collect():
        found.setdefault(r["label"], set()).add(r["doc_id"])
    wanted = {}
    for at, p in enumerate(parent):
        wanted.setdefault(p, set()).add(at)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_first_shingles_meet_every_similar_set():
    """Under any counts, sets at 0.8 or more share a key, and the first they share passes the bound on what follows."""
    rng = np.random.default_rng(17)
    similar = 0
    for _ in range(400):
        n = int(rng.integers(1, 80))
        x = rng.choice(500, n, replace=False)
        kept = x[rng.random(n) < rng.choice([0.8, 0.9, 1.0])]
        y = np.union1d(kept, rng.integers(500, 900, int(rng.integers(0, max(n // 6, 2)))))
        x, y = np.unique(x).astype(np.int64), y.astype(np.int64)
        common = len(np.intersect1d(x, y))
        if common * 5 < 4 * (len(x) + len(y) - common):
            continue
        similar += 1
        counts = np.zeros(near_copies.COUNTERS, np.int64)
        counts[:900] = rng.integers(0, 6, 900)
        a, b = (near_copies.first_shingles(s, counts).tolist() for s in (x, y))
        met = [(len(x) - i, len(y) - b.index(k)) for i, k in enumerate(a) if k in b]
        assert any(9 * min(rests) >= 4 * (len(x) + len(y)) for rests in met)
    assert similar > 100


@pytest.mark.parametrize("bucket", [2, 16])
def test_near_copies_that_share_a_passage(spark, bucket):
    """Many texts with one long passage in common, some of them near copies of each other: groups as by all pairs."""
    rng = np.random.default_rng(23)
    passage = [f"p{k}" for k in range(120)]
    texts = []
    for own in (10, 20, 30, 40, 80):
        for _ in range(14):
            words = [f"w{k}" for k in rng.integers(0, 10**6, own)]
            texts.append(" ".join(words + passage))
            if rng.random() < 0.5:
                words[int(rng.integers(0, own))] = "changed"
                texts.append(" ".join(passage + words))
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    wanted, found = {}, {}
    for at, p in enumerate(parent):
        wanted.setdefault(p, set()).add(at)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in near_copies.near_copies(df, bucket=bucket).collect():
        found.setdefault(r["label"], set()).add(r["doc_id"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))
    assert 1 < len(wanted) < len(texts)


def removed(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    out = []
    for t in data:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                step[i] += 1
                step[i + 200] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeats(rng):
    base = "".join(rng.choice(list("abcdefgh "), 2500))
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, base[:199], base[:200], "é" * 300, "ab" * 300, base[100:800] + base[100:800]]
    for _ in range(30):
        a, b = sorted(rng.integers(0, 2500, 2))
        t = base[a:b]
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(t) + 1))
            t = t[:k] + "#" * int(rng.integers(1, 3)) + t[k:]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup_matches_brute_force(spark, texts, seed):
    all_texts = [*list(texts.values())[seed * 60 : seed * 60 + 60], *repeats(np.random.default_rng(seed))]
    df = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(removed(all_texts)))


def test_long_texts_are_cut_into_stretches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng, starts = np.random.default_rng(0), Counter()
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (100, 200, 650, 699, 701, 5000)]
    for data, ends, key, offset in suffix_dedup._stretches(list(range(6)), texts):
        for k, o, a, b in zip(key, offset, np.concatenate([[0], ends[:-1]]), ends):
            assert bytes(data[a:b]) == texts[k][o : o + b - a]
            starts.update((int(k), int(o) + i) for i in range(b - a - 199))
    assert starts == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 199))


def test_suffix_dedup_of_awkward_rows(messy):
    rows = suffix_dedup.remove_repeats(messy, keep_text=True).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"])
    assert all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] in (8, 9))
    assert suffix_dedup.remove_repeats(messy.where("false")).count() == 0


def test_quality_matches_brute_force(docs, texts):
    for r in quality_rules.quality(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_lines_common_on_a_host_go(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits would all be alike
    body = lambda i: " ".join(f"{letters(i)}x{letters(k)}" for k in range(30))
    rows = [(i, f"Accept all  cookies 12 please\n{body(i)}", "a") for i in range(6)]
    rows += [(10, "accept ALL cookies 7 please\n" * 8 + "only these few words are its own " * 1, "a")]
    rows += [(20 + i, f"Accept all cookies 12 please\n{body(i)}", f"host{i}") for i in range(6)]
    rows += [(30, body(99), "b")] * 5 + [(40 + i, body(98), "b") for i in range(5)]
    got = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_part=2, line_floor=5).collect()}
    assert got[0]["words_removed"] == 5 and got[0]["kept"]
    assert got[10]["words_removed"] == 40 and not got[10]["kept"]
    assert got[20]["words_removed"] == 0 and got[20]["kept"]
    assert got[30]["words_removed"] == 0 and got[40]["words_removed"] == 0 and got[40]["kept"]


def test_quality_of_awkward_rows(messy):
    assert quality_rules.quality(messy).count() == messy.count()
    assert quality_rules.quality(messy.where("false")).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans_of(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_match_brute_force(spark, docs, messy):
    hard = ["secret=token: abcdef", "🙂 PASSWORD: \"x_.y=zz\" é", "AKIA" * 3 + "A" * 20 + " AKIA1", "apikey='deadbeef" + "0123456789abcdef" * 3, "token=abcdef " * 900, None]
    extra = spark.createDataFrame(list(enumerate(hard, 10**9)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(extra), messy):
        known = df.select("doc_id", "text").collect()
        want = Counter()
        for r in known:
            s = spans_of(r["text"] or "")
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()
            want[r["doc_id"], *[sum(x[1] == n for x in s) for n in range(3)], digest] += 1
        got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.secret_report(df).collect())
        assert got == want


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigram_query("(ab|cd)ef") == ("or", (("and", ("abe", "bef")), ("and", ("cde", "def"))))


def test_redaction_keeps_the_rest(spark, messy):
    text = "é token = abcdefg and " + "deadbeef" * 4 + " end"
    df = spark.createDataFrame([(1, text, 5), (2, "clean", 5), (3, None, 5)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r for r in secret_scan.redact_secrets(df).collect()}
    assert got[1]["text"] == "é [SECRET] and [SECRET] end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[3]["text"] is None
    assert secret_scan.redact_secrets(messy).columns == messy.columns
    assert {r["spans"] for r in secret_scan.redact_secrets(messy).collect()} == {"own spans"}


def snapshots(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", None)]
    rows += [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (6, 0, None, "hi")]
    rows += [(7, None, "user", "x"), (7, 1, "user", "y"), (None, 0, "user", "lone"), (3, 2, "user", None), (8, 3000, "user", "late"), (8, 1, "user", "early"), (9, 1, "user", "early")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_snapshots_collapse_to_maximal_conversations(spark):
    got = {r["conv_id"]: (r["n_turns"], r["n_same"]) for r in chat_format.maximal_conversations(snapshots(spark)).collect()}
    assert got == {3: (3, 1), 4: (2, 2), 6: (1, 1), 7: (2, 1), None: (1, 1), 8: (2, 1)}
    text = "".join(r["rendered"] for r in chat_format.format_chats(snapshots(spark)).where("conv_id = 3").orderBy("turn").collect())
    assert text == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\n\n"


def test_chat_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    conversations = snapshots(spark).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    key = lambda r: tuple(repr(x) for x in r)
    want = sorted(map(key, con.sql(chat_format.OP9_SQL).fetchall()))
    assert sorted(map(key, chat_format.format_chats(snapshots(spark)).select("conv_id", "turn", "role", "rendered", "n_turns", "n_same").collect())) == want
    assert chat_format.format_chats(snapshots(spark).where("false")).count() == 0


QUESTION = "Yesterday Tom bought 5 apples for 9 dollars and then Tom gave them to her brother because the shop was closing early"


def test_reparameterised_questions_are_caught(spark):
    items = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, "too short"), (3, None), (None, "a question with no number that is long enough to be matched by its words")], "item_id long, text string")
    rows = [
        (1, "Filler before. " + QUESTION.replace("Tom", "Anna").replace("5", "17").replace("9", "3") + " and after"), (2, QUESTION.upper()), (3, None), (4, ""),
        (5, "completely different words that share nothing with any question at all " * 4), (6, "a question with no number that is long enough to be matched by its words"),
        (7, " ".join(f"{QUESTION.split()[k]} other" for k in range(20))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, items).collect() if r["item_id"] is not None)
    assert (1, 1) in got and not {d for d, _ in got} & {3, 4, 5, 7}
    assert 6 in {r["doc_id"] for r in decontaminate.contaminated_pairs(docs, items).where("item_id is null").collect()}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()} >= {3, 4, 5, 7}


def test_slots_must_map_one_to_one(spark):
    items = spark.createDataFrame([(1, "so 1 and then 2 and then 1 and then 2 and then 1 and then 2 end")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so 7 and then 8 and then 7 and then 8 and then 7 and then 8 end"), (2, "so 7 and then 8 and then 9 and then 3 and then 4 and then 5 end")], "doc_id long, text string")
    got = {r["doc_id"]: r["coverage"] for r in decontaminate.contaminated_pairs(docs, items, similarity=0.0, run=99).collect()}
    assert got[1] == 1.0 and got.get(2, 0.0) < 0.8


APPLES = "If Tom has 3 apples and Mary has 5 then how many apples do Tom and Mary have if Ben gives each 4 more"


def versions(rng, n):
    """APPLES with other names and numbers, ``n`` times in one text."""
    out = []
    for _ in range(n):
        names, numbers = rng.permutation(["Anna", "Omar", "Lin", "Eva", "Paul", "Nora"])[:3], rng.permutation(np.arange(6, 99))[:3]
        new = dict(zip(["Tom", "Mary", "Ben", "3", "5", "4"], [*names, *map(str, numbers)]))
        out.append(" ".join(new.get(w, w) for w in APPLES.split()))
    return " ".join(out)


def test_versions_of_an_item_in_one_document_are_found(spark):
    rng = np.random.default_rng(3)
    rows = [versions(rng, 1 + k % 10) for k in range(60)] + [f"{APPLES} {versions(rng, 2)}" for _ in range(20)]
    words = APPLES.split()
    rows += [" ".join([*words[:11], *[f"filler{k}" for k in range(60)], *words[11:]]), " ".join([*words[:12], "well", *words[12:]])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    items = spark.createDataFrame([(1, APPLES)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated_pairs(docs, items, similarity=0.7).collect()} == set(range(len(rows)))
    found = {r["doc_id"] for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert set(range(80)) <= found


def test_copies_of_items_dense_in_slots_are_found(spark):
    dense = [
        "Evaluate 12 + 15 * 3 - 7 and divide by 4", "Who wrote The Old Man And The Sea in 1952 and won The Nobel Prize In Literature",
        "Solve 3x + 5 = 2x - 7 for x given y = 4 and z = 9", "1 2 3 4 5 6 7 8 9",
    ]
    items = spark.createDataFrame(list(enumerate(dense)), "item_id long, text string")
    rows = [f"Some words before. {t} and some after" for t in dense] + ["9 8 7 6 5 4 3 2 1 and The Young Man And The River In Love"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert got == {(i, i): 1.0 for i in range(len(dense))}


def test_planted_benchmark_items_are_found(spark, docs):
    items = {r["item_id"]: " ".join(r["text"].split()) for r in read_table(spark, SF, "benchmark").collect()}
    whole = {(d, i) for d, t in ((r["doc_id"], " ".join((r["text"] or "").split())) for r in docs.collect()) for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op4_decontaminate(spark, SF).collect()}
    assert whole and whole <= got and len(got) <= len(whole) + 3


def test_blocks_of_benchmark_windows_give_the_same_hits(spark, docs):
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("content"), "text")
    items = decontaminate.item_windows(decontaminate.item_classes(read_table(spark, SF, "benchmark"))).cache()
    one, many = (sorted((r["id"], r["place"], r["length"], r["window"]) for r in decontaminate.hits(rows, items, block=b).collect()) for b in (10**6, 300))
    assert one and one == many


def test_decontamination_of_awkward_rows(spark, messy):
    bench = read_table(spark, SF, "benchmark")
    kept = decontaminate.drop_contaminated(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert decontaminate.contaminated_pairs(messy, bench.where("false")).count() == 0
    assert decontaminate.contaminated_pairs(messy.where("false"), bench).count() == 0


def test_toxicity_of_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows = toxicity.op10_toxicity(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)


def test_toxicity_of_awkward_rows(spark, messy):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    w = toxicity.fit(messy, labels)
    rows = toxicity.toxicity_scores(messy, w).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(messy, labels.where("false"))
    assert all(r["score"] < 0.5 for r in toxicity.toxicity_scores(messy, none).collect())


def test_ftrl_leaves_few_weights():
    rng = np.random.default_rng(0)
    x = [np.unique(np.concatenate([rng.integers(100, 1000, 20), [7] if k % 2 else [8]])) for k in range(400)]
    w = toxicity.ftrl(x, np.arange(400) % 2, bits=10, l1=4.0)
    assert {7, 8} <= set(w.places.tolist()) and len(w.places) < 100
    assert all((w.margin(v.astype(np.uint64)) > 0) == bool(k % 2) for k, v in enumerate(x))


def test_pipeline_stages(spark, docs, texts):
    kept = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        sizes.append(kept.count())
        if name != "encoding":
            assert kept.columns == docs.columns
        if name == "near dedup":
            assert {r["doc_id"] for r in kept.collect()} == set(similar_groups(texts).values())
        if name == "secrets":
            assert all(not spans_of(r["text"]) for r in kept.collect())
    assert sizes[0] == len(texts) and sizes == sorted(sizes, reverse=True) and sizes[4] == sizes[2]
    lib = library()
    row = kept.orderBy("doc_id").first()
    assert row["n_tokens"] == len(row["ids"]) and row["decoded_sha256"] == hashlib.sha256(lib.decode(row["ids"], skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_of_awkward_rows(spark, docs, messy):
    small = messy.select(docs.columns).unionByName(docs.limit(60))
    for _, stage in corpus_pipeline.STAGES:
        small = stage(spark, small, SF)
    assert small.count() > 50


def test_every_query_is_registered():
    names = list(llm_queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] and set(llm_queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm_queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(llm_queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(repr, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(repr(r[i]) for i in at) for r in rel.fetchall())
