"""Manifest, resampling and BPE against brute force, over rows with every oddity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageloom.llm import bpe, catalog, language, manifest, ordinals, resampling

from odd_rows import LONG, ROWS, SHARED, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [
    "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext", "   x\u0085y​", "it's I'LL we've'd",
    "ȩ́ 中文字 \U0001F469‍\U0001F52C", "\U0001FAE9 Ᲊ \U00010D40", "a͸b՘c\U000323B0d \U0003FC36", "\x00\x01\x7f \r\n\t\n  end  ",
    "۱٢²⅕ IXⅨ", "0" * 3000, "xyz" * 3000, " " * 999 + "x",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def multiset(rows):
    return Counter(map(tuple, rows))


def full_rows():
    """doc_id, text, lang, source, n_chars: sources of very different sizes, one of them null, one with a third of all."""
    rnd = random.Random(5)
    rows = [(i, t, rnd.choice(["en", None, "de"]), rnd.choice([None, "", "a", "ä", "b"]), rnd.choice([len(t or ""), None])) for i, t in ROWS]
    rows += [(100 + i, prose(i, 25) + ("\n" if i % 3 else ""), "en", "hot", 5) for i in range(60)]
    rows += [(400 - i, f"text {i}\n", None, f"s{i}", i) for i in range(40)]
    return rows + rows[6:8]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    extra = "position long, total long, tree string, digest string, place long, n_words long, score long, ids string, rank int"
    rows = [(*row, 1, 2, "t", "d", 3, 4, 5, "i", 6) for row in full_rows()]
    table = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    table.repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = [(1, SHARED), (2, "two words"), (3, ""), (4, None), (5, prose(6, 30)), (5, prose(30, 12)), (None, prose(8, 10))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


# --- manifest ------------------------------------------------------------------------


def leaf(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
    return levels


def brute_manifest(rows, arity=3):
    """The contract, whole trees in memory."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[3]].append(row)
    for held in sources.values():
        held.sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(*row)))
    trees = {source: tree([leaf(*row) for row in held], arity) for source, held in sources.items()}
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    upper = tree([trees[s][-1][0] for s in order], arity)
    out = []
    for place, source in enumerate(order):
        for nth, row in enumerate(sources[source]):
            runs = []
            for levels, at in ((trees[source], nth), (upper, place)):
                for level in levels[:-1]:
                    runs.append((level[at - at % arity:at - at % arity + arity], at % arity))
                    at //= arity
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            digest = leaf(row[0], text, *row[2:])
            for run, at in runs:
                digest = sha("".join([*run[:at], digest, *run[at + 1:]]))
            proof = "".join(h for run, at in runs for i, h in enumerate(run) if i != at)
            out.append((row[0], trees[source][0][nth], trees[source][-1][0], upper[-1][0], sha(proof), digest, digest == upper[-1][0]))
    return out


def test_manifest(spark, sf_dir):
    want = brute_manifest(full_rows())
    assert multiset(catalog.op11_manifest(spark, sf_dir).collect()) == multiset(want)
    assert {row[-1] for row in want} == {True, False}


@pytest.mark.parametrize("arity, depth", [(3, 1), (2, 2), (4, 3)])
def test_manifest_does_not_depend_on_the_stored_levels(spark, sf_dir, arity, depth):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = manifest.manifest(docs, arity=arity, depth=depth)
    got = rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()
    assert multiset(got) == multiset(brute_manifest(full_rows(), arity))


@pytest.mark.parametrize("rows", [[(5, "a\nb")], [(5, "a\nb"), (6, "c")], [(i, f"{i}\n") for i in range(28)]])
def test_small_manifests(spark, rows):
    docs = documents(spark, rows)
    got = manifest.manifest(docs, depth=2).select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified")
    assert multiset(got.collect()) == multiset(brute_manifest([(i, t, "en", "src", len(t)) for i, t in rows]))


def test_a_proof_detects_every_change_of_a_field(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(30)])
    for name in manifest.FIELDS:
        change = lambda columns, name=name: columns | {name: F.lit(None).cast("string")}
        got = manifest.manifest(docs, change, F.col("doc_id") < 9).groupBy("verified").count().collect()
        assert {row.verified: row["count"] for row in got} == {True: 21, False: 9}


def test_proofs_fold_to_the_root_of_a_large_source(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"),
        F.lit(1).alias("n_chars"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    rows = manifest.manifest(docs, depth=3, is_tampered=F.lit(False)).collect()
    want = {row[0]: row for row in brute_manifest([(i, f"t{i}", "en", None, 1) for i in range(5000)])}
    assert len(rows) == 5000 and all(row.verified for row in rows)
    for row in rows[::97]:
        assert (row.leaf, row.root, sha(row.proof)) == (want[row.doc_id][1], want[row.doc_id][3], want[row.doc_id][4])
        assert manifest.folded(bytes.fromhex(row.leaf), row.proof, row.steps).hex() == row.root


def test_numbered_deals_a_large_group_to_many_tasks(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 3000).alias("v"))
    got = ordinals.numbered(rows, ["g"], ["v"]).collect()
    groups = defaultdict(list)
    for row in got:
        groups[row.g].append(row)
    assert len(got) == 3000 and None in groups
    for held in groups.values():
        held.sort(key=lambda row: row.v)
        assert [row.position for row in held] == list(range(len(held))) and {row.total for row in held} == {len(held)}
    alone = sorted(ordinals.numbered(rows.select("v"), [], ["v"]).collect())
    assert [(row.position, row.total) for row in alone] == [(i, 3000) for i in range(3000)]


# --- resampling ----------------------------------------------------------------------


def features(text, max_run):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, bench, percent=10, min_words=20, max_run=1, buckets=10_000, seed=2024):
    bucket = lambda feature: zlib.crc32(feature.encode()) % buckets
    corpus, target = (Counter(bucket(f) for t in texts for f in features(t, max_run)) for texts in ([t for _, t in docs], bench))
    s_all, t_all = sum(corpus.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = features(text, max_run)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(features(text, 1))])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[:percent * len(able) // 100]):
        row[4] = place + 1
    return [row[:5] for row in rows]


BENCH = [SHARED, "two words", "", None, prose(6, 30), prose(30, 12), prose(8, 10)]


def test_resampling(spark, sf_dir):
    docs = [(row[0], row[1]) for row in full_rows()]
    got = catalog.op12_resampling(spark, sf_dir).collect()
    assert multiset(got) == multiset(brute_resample(docs, BENCH))
    assert any(row["rank"] == 1 for row in got)


@pytest.mark.parametrize("max_run, size, percent, min_words", [(1, 3, 50, 0), (2, 1 << 15, 100, 20), (2, 4, 33, 5), (4, 50, 10, 1), (1, 5, 0, 20)])
def test_resampling_does_not_depend_on_the_head(spark, monkeypatch, max_run, size, percent, min_words):
    monkeypatch.setattr(resampling, "HEAD", size)
    monkeypatch.setattr(resampling.head, "__defaults__", (1, 10_000, size))
    docs = documents(spark)
    target = spark.createDataFrame([(t,) for t in BENCH], "text string")
    got = resampling.resample(docs, target, percent, min_words, max_run, 500, 7).collect()
    assert multiset(got) == multiset(brute_resample(ROWS, BENCH, percent, min_words, max_run, 500, 7))


def test_the_head_holds_the_frequent_features(spark):
    docs = documents(spark, [(i, "the cat sat on the mat " * 20 + f"rare{i}") for i in range(50)])
    held = resampling.head(docs, 2, 100, 5).value
    assert b"the" in held["states"] and (b"the", b"cat") in held["pairs"] and len(held["states"]) <= 5
    assert not any(word.startswith(b"rare") for word in held["states"])


def test_resampling_prefers_the_target(spark):
    near = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=40))) for i in range(100)]
    far = [(100 + i, prose(1000 + i, 40)) for i in range(300)]
    target = spark.createDataFrame([("alpha beta gamma delta " * 20_000,)], "text string")
    drawn = resampling.resample(documents(spark, near + far), target, 25).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 100 and sum(row.doc_id < 100 for row in drawn) >= 95


def test_resampling_without_target_texts(spark):
    target = spark.createDataFrame([], "text string")
    got = resampling.resample(documents(spark), target).collect()
    assert multiset(got) == multiset(brute_resample(ROWS, []))


# --- BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def test_bpe(spark, sf_dir, library):
    def row(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))

    assert multiset(catalog.op13_bpe(spark, sf_dir).collect()) == multiset(row(r[0], r[1]) for r in full_rows())


def test_bpe_of_odd_texts(spark, library):
    rnd = random.Random(9)
    anything = ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(128)])) for _ in range(200)) for _ in range(40)]
    rows = list(enumerate(ODD_TEXTS + anything + [LONG]))
    tokens = bpe.encode(documents(spark, rows).select("doc_id", "text"))
    found = {r.doc_id: r for r in tokens.collect()}
    for doc_id, text in rows:
        assert found[doc_id].ids == library.encode(text, add_special_tokens=False).ids, text[:80]
    back = {r.doc_id: r.text for r in bpe.decode(tokens).collect()}
    assert back == dict(rows)


def test_merges_of_an_endless_word_take_no_quadratic_time(library):
    import time

    with open(bpe.TOKENIZER, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    words = ["a" * 200_000, "".join(random.Random(1).choices("abcdefgh", k=200_000))]
    start = time.perf_counter()
    found = [vocabulary.encode(word) for word in words]
    assert time.perf_counter() - start < 20
    assert found == [library.encode(word).ids for word in words]


def test_decoding_cut_ids_and_null_ids(spark, library):
    ids = library.encode("中文 é").ids
    rows = [(1, ids[:1]), (2, ids[1:]), (3, None), (4, [])]
    got = {r.k: r.text for r in bpe.decode(spark.createDataFrame(rows, "k long, ids array<int>")).collect()}
    assert got == {1: library.decode(ids[:1]), 2: library.decode(ids[1:]), 3: "", 4: ""}


def test_encode_keeps_other_columns_and_refuses_clashes(spark):
    docs = documents(spark, [(1, "one two"), (1, "one two"), (None, None)])
    got = bpe.encode(docs)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    assert multiset((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter({(1, (505, 734)): 2, (None, ()): 1})
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)))


def test_a_file_with_other_steps_is_refused():
    with open("/opt/tokenizers/word_bpe_49k.json", encoding="utf-8") as file, pytest.raises(ValueError):
        bpe.Vocabulary(file.read())


def test_numerals_are_no_letters():
    assert language.letter_words("½ ² ① Ⅷ 12 _ ٣") == []
    assert language.letter_words("Größe x² née") == ["größe", "x²", "née"]
