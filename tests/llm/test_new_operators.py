"""Operators 11 to 13 against the tokenizer's library, brute force and plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adsentry.llm import _repeats, byte_pairs, decontaminate, exact_digest, merkle, quality, secret_scan, simhash_dedup, spelling, substring_dedup

from . import brute

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])


# byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.Coder(byte_pairs.read_ranks(public_tokenizers.path(byte_pairs.RANKS)), public_tokenizers.PATTERN, byte_pairs.character_classes())


ALPHABETS = ["a", "ab '", "'relsdtmv ", "  \n\t x", "漢字仮名", "😀👍a", "é'sß ", "0123 ", "!?'s. ", "aA1!  '\n漢😀ß"]
TAILS = ["'", "a" * 40, "'resident " * 5, " " * 30, " " * 30 + "x", "ha" * 30, "'" * 20 + "s", "'" + "re" * 9]


@pytest.mark.parametrize("leaf", [1, 2, 7])
def test_joined_encodings_are_those_of_the_library(coder, monkeypatch, leaf):
    monkeypatch.setattr(byte_pairs, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(700):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.choice([0, 1, 2, 5, 10, 30, 100]))) + rng.choice(TAILS) * rng.randrange(2)
        text += "".join(rng.choice(ALPHABETS[rng.randrange(10)]) for _ in range(rng.randrange(20)))
        ids = coder.encode(text)
        assert ids.tolist() == coder.library.encode_ordinary(text)
        assert coder.decode(ids).decode() == text


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000, "ha" * 100_000, "漢" * 100_000, "=-" * 100_000])
def test_long_runs(coder, text):
    assert coder.encode(text).tolist() == coder.leaf(text).tolist()
    assert coder.decode(coder.encode(text)).decode() == text


def test_every_token_is_its_own_encoding(coder):
    """The rule of pairs holds for vocabularies of this kind only."""
    assert all(coder.library._core_bpe.encode_single_piece(t) == [i] for i, t in enumerate(coder.tokens))


def digested(coder, doc_id, text):
    ids = coder.library.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_11(spark, coder):
    got = byte_pairs.op11_byte_pairs(spark, SF)
    assert ordered(got.collect()) == ordered(digested(coder, r[0], r[4]) for r in documents(spark))


@pytest.mark.parametrize("block", [40, 1000])
def test_long_texts_are_joined_level_by_level(spark, coder, block):
    texts = ["", None, "kurz", "word's  end " * 300, "word's  end " * 300, "漢字😀" * 700, "a" * 3000, " \n" * 900 + "x", "x" * block, "y" * (block + 1)]
    rows = [(i if i != 4 else 3, t, "extra") for i, t in enumerate(texts)] + [(None, "null id " * 200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.ids` string")
    got = byte_pairs.digests(byte_pairs.encoded_bytes(docs, block=block)).collect()
    assert ordered(got) == ordered(digested(coder, i, t) for i, t, _ in rows)


def test_encoded_and_decoded(spark, coder):
    docs = spark.createDataFrame([(1, "Ein Satz, it's 12."), (2, None), (3, "")], "doc_id long, text string")
    ids = byte_pairs.encoded(docs)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: coder.library.encode_ordinary("Ein Satz, it's 12."), 2: [], 3: []}
    assert {r.doc_id: bytes(r.bytes).decode() for r in byte_pairs.decoded(ids).collect()} == {1: "Ein Satz, it's 12.", 2: "", 3: ""}
    assert byte_pairs.encoded(docs.where("doc_id > 9")).count() == 0


# spelling variants


def misspelt(doc_id, run):
    run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def near(words):
    places, found = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            places[w[:i], w[i + 1 :]].add(w)
            rest = w[:i] + w[i + 1 :]
            if rest in words:
                found[w].add(rest)
                found[rest].add(w)
    for group in places.values():
        for w in group:
            found[w] |= group - {w}
    return found


def variants(n):
    found, form, out = near(n), {}, []
    for w in n:
        best = min(found[w], key=lambda y: (-n[y], y), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(found[w]), n.get(form.get(w))))
    return out


def test_query_12(spark):
    n = Counter(misspelt(r[0], m) for r in documents(spark) for m in re.findall("[A-Za-zÀ-ÿ]+", r[4] or ""))
    got = spelling.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n")
    assert ordered(got.collect()) == ordered(variants({w: c for w, c in n.items() if len(w) >= 7 and c >= 2}))


def test_near_words_of_few_letters(spark):
    """Words of two letters make all kinds of runs and branches; some are longer than a level for each letter allows."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))) for _ in range(150)}
    for size in (63, 64, 65, 66, 90):
        word = "".join(rng.choice("abc") for _ in range(size))
        words |= {word, word[:30] + "x" + word[31:], word[:20] + word[21:], word[:-1], "y" + word[1:], word + "z"}
    n = {w: rng.randrange(2, 3000) for w in words}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    got = spelling.near_words(frame, shortest=3)
    want = near(set(n))
    assert ordered(got.collect()) == ordered((w, y, n[y]) for w in want for y in want[w])
    result = spelling.variants(frame, shortest=3)
    assert ordered(result.collect()) == ordered(variants(n))


def test_chains_of_forms(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000, "aabbbbb": 200000, "zzzzzzz": 2}
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    assert ordered(spelling.variants(frame).collect()) == ordered(variants(n))


def test_words_of_hard_rows(spark):
    rows = [(1, None, "x"), (None, "Überraschung Überraschung×haus", "x"), (1, "überraschung", "x"), (2, "kurz " * 9, "x"), (2, "kurz " * 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.word` string")
    n = Counter(misspelt(i, m) for i, t, _ in rows for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    got = spelling.counted(spelling.misspelt(docs))
    assert ordered(got.collect()) == ordered((w, c) for w, c in n.items() if len(w) >= 7 and c >= 2)
    assert spelling.variants(spelling.counted(spelling.misspelt(docs.where("doc_id = 9")))).count() == 0


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    values = [v.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if lower and i == 4 and v is not None else v for i, v in enumerate(row)]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
        i //= 8


def manifest(rows):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[n]]) for n in names]
    top = levels([t[-1][0] for t in trees])
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = [*siblings(trees[k], i), *siblings(top, k)]
            folded = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in path:
                folded = sha(a + folded + b)
            yield r[0], leaf(r), trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]


def test_query_13(spark):
    got = merkle.op13_merkle_manifest(spark, SF).collect()
    assert ordered(got) == ordered(manifest(documents(spark)))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 9, 600])
def test_manifest_of_hard_rows(spark, count):
    rng = random.Random(count)
    ids = lambda: rng.choice([None, None, 5, 5, -3, rng.randrange(-50, 50), rng.randrange(10**18), -rng.randrange(10**18), rng.randrange(40_000)])
    rows = [(ids(), rng.choice([None, "", "ABC", f"Text {rng.randrange(9)}", "É" * 30]), rng.choice([None, "", "de", "en", "en", f"ab{rng.randrange(20)}"]), rng.choice([None, "s"]), rng.choice([None, 3])) for _ in range(count)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCUMENTS + ", `a.place` string")
    got = merkle.manifest(merkle.leaves(docs))
    assert ordered(got.collect()) == ordered(manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))


# rules mended later


def test_placeholders_spare_their_own_part_only(spark):
    token = "AbCd9fKq27LmZx83RtYpQw0VnB5sGhJ4"
    texts = [f"https://host.test/samples/{token}", "Q7xK2mZ9pL4vR8tW1yB6nD3fG5hJ0sAc-example", f"{token[:9]}example{token[9:]}", "key your_1234567890AbCdEfGhIj", f"x/{token}=sample_{token}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.secrets] for r in secret_scan.scan(docs).collect()}
    assert token in found[0][0]
    assert found[1] == ["Q7xK2mZ9pL4vR8tW1yB6nD3fG5hJ0sAc-"]
    assert found[2] == found[3] == []
    assert len(found[4]) == 1
    assert {i: [(s, k, e) for s, _, k, e in brute.secret_spans(t)] for i, t in enumerate(texts)} == {r.doc_id: [(s.start, s.kind, s.stop) for s in r.secrets] for r in secret_scan.scan(docs).collect()}


def test_case_is_folded(spark):
    pairs = [("STRASSE und so", "straße und so"), ("ΟΔΟΣ", "οδος"), ("οδοσ", "οδος"), ("ﬁn", "FIN"), ("ＡＢ  c", "ab c"), ("ŉ", "ʼN")]
    docs = spark.createDataFrame([(i, t) for i, p in enumerate(pairs) for t in p], "doc_id long, text string")
    found = exact_digest.digests(docs).groupBy("doc_id").agg(F.count_distinct("digest").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.n, r.rows) for r in found} == {(1, 2)}


def test_stages_take_columns_with_dots(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("a.b", F.col("doc_id") * 2).withColumn("x`y", F.lit("z"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for stage in (quality.kept, simhash_dedup.one_of_each, lambda d: decontaminate.clean(d, items), secret_scan.clean):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r["a.b"] == 2 * r["doc_id"] and r["x`y"] == "z" for r in rows)


# long texts of op2 and op8


@pytest.mark.parametrize(("tokens_of", "length", "gram"), [(_repeats.byte_tokens, 50, 16), (_repeats.word_tokens, 20, 8)])
def test_anchors_of_long_texts_do_not_depend_on_parts(monkeypatch, tokens_of, length, gram):
    """Cut into parts of a few words, long texts have the anchors, surroundings and places that they have in one part."""
    rng = random.Random(17)
    word = lambda: b"".join(rng.choice([b"a", b"b", "é".encode()]) for _ in range(rng.choice([1, 3, 5, 9])))
    passage = b" ".join(word() for _ in range(90))
    texts = [b"", b"x" * 5000, b" " * 3000, b"ab " * 900, passage * 6, b"w " * 19] + [b" ".join(word() for _ in range(rng.randrange(700))) + rng.choice([b" ", b"\n", b""]) + passage[rng.randrange(200) :] for _ in range(12)]
    rows = pa.table({"id": pa.array(range(len(texts))), "no_id": pa.array([False] * len(texts)), "text": pa.array(texts, pa.binary())})
    chunk, found = _repeats.Chunk(rows), []
    for block in (1 << 20, 1500, 130, 7):
        monkeypatch.setattr(_repeats, "BLOCK", block)
        f = _repeats.find(chunk, tokens_of, length, gram, 8)
        found.append(sorted(zip(*(x.tolist() for x in (f.doc, f.first, f.last, f.lo, f.hi, f.gram[f.entry], f.around[f.entry])), strict=True)))
    assert len(found[0]) > 500
    assert found[0] == found[1] == found[2] == found[3]


@pytest.mark.parametrize("hot", [4096, 1])
def test_periodic_texts(spark, monkeypatch, hot):
    """Texts whose windows stand in them many times, in several documents, with other words between."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(23)
    bases = ["wort ", "abc", "ä-", "x", "lange periode mit vielen zeichen und noch mehr davon, über fünfzig bytes; "]
    texts = [None, ""] + ["".join(rng.choice(bases) * rng.randrange(1, 90) + rng.choice(["", "!", "Q"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = substring_dedup.dedup_substrings(docs).select("doc_id", F.octet_length("text"), F.octet_length("text") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute.substring_dedup(list(enumerate(texts)))


@pytest.mark.parametrize("block", [512, 3])
def test_groups_by_heads_are_those_of_all_pairs(spark, monkeypatch, block):
    """Chains of texts around the threshold: what links of any two texts connect, the links by heads and blocks connect."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = random.Random(12)
    texts, base = {}, [f"w{i}" for i in range(60)]
    for root in range(4):
        words = list(base)
        for _ in range(25):
            if rng.random() < 0.25:
                words = list(rng.choice([base, words]))
            for at in rng.sample(range(60), rng.choice([0, 1, 1, 2])):
                words[at] = f"v{rng.randrange(10**6)}"
            texts[root * 1000 + rng.randrange(1000)] = (root, " ".join(words))
    grams = {k: {tuple(t.split()[i : i + 5]) for i in range(56)} for k, (_, t) in texts.items()}

    def groups(pairs):
        top = {k: k for k in texts}
        for a, b in pairs:
            old, new = top[a], top[b]
            top = {k: new if t == old else t for k, t in top.items()}
        return {frozenset(k for k in top if top[k] == t) for t in top.values()}

    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    every = [(a, b) for a in texts for b in texts if a < b and texts[a][0] == texts[b][0] and like(a, b) >= 0.8]
    nodes = spark.createDataFrame([(r, k, 0, t) for k, (r, t) in texts.items()], "root long, key long, fp long, text string")
    found = [tuple(sorted(r)) for r in simhash_dedup.verified(nodes, 5, 64, 0.8).collect()]
    assert set(found) <= set(every)
    assert groups(found) == groups(every)
    assert 8 < len(groups(every)) < len(texts) - 8
    assert any(0.6 <= like(a, b) < 0.8 for a in texts for b in texts if a < b)
