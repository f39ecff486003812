"""Ids and decoded texts against the tokenizers library; refusals; merges by rank as brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm import bpe
from auditloom.llm.queries import op11_prefix_bpe, tokenizer_path

WORD = tokenizer_path()
BYTE = WORD.replace("word_bpe_49k", "byte_bpe_50k")
rng = random.Random(8)
LETTERS = "abcdefghijklmnopqrstuvwxyzéßαβσ '.,!<|>\n\t0123AEIOUΣ日🎉́"
ODD = ["", " \t\n", "One", "Σίσυφος ÉTÉ été ΑΣ", "a\x00b", "<|endoftext|> x", "<|ENDOFTEXT|>", "it's WE'LL 's", "aaaaaaaaaaaaaaaaa", "x" * 3000, "日本語 中文", "é ́", "İstanbul", "a\x85b\xa0c", "1234 5.6!!!...", "ẞ ﬁ Å", "word! Word? WORD, word"]
TEXTS = [*ODD, *("".join(rng.choices(LETTERS, k=rng.randint(1, 60))) for _ in range(600)), *("".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(200)), *("".join(rng.choices("aneirst", k=rng.randint(1, 40))) for _ in range(400)), " ".join("".join(rng.choices("aneirst", k=5)) for _ in range(30_000))]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_same_as_library(path):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.ids(text) == ids
        assert codec.both(text) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def merged(word, ranks):
    """The lowest rank first, from the left."""
    parts = list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_random_vocabularies():
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append([a, b])
        ranks = {tuple(m): i for i, m in enumerate(merges)}
        codec = bpe.PrefixBpe({"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges})
        for _ in range(40):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert [codec.names[i] for i in codec.word(word)] == merged(word, ranks)


def test_every_prefix_has_one_last_token():
    codec = bpe.Codec(WORD).bpe
    word = "internationalizationist"
    for n in range(1, len(word) + 1):
        letters = word[: n - 1] + chr(bpe.LAST + ord(word[n - 1]))
        fits = [t for _, (_, i, t) in codec.automaton.iter(letters) if letters.endswith(t) and codec.word(word[:n])[-1] == i]
        assert len(fits) == 1


def test_refusals():
    plain = {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}
    for change in ({"byte_fallback": True}, {"unk_token": "a"}, {"dropout": 0.1}, {"ignore_merges": True}, {"type": "Unigram"}, {"merges": [["a", "b"], ["a", "b"]]}, {"merges": [["ab", "a"]]}):
        with pytest.raises(ValueError):
            bpe.PrefixBpe(plain | change)
    with pytest.raises(KeyError):
        bpe.PrefixBpe(plain).word("abz")


def test_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = [None, *TEXTS]
    docs = spark.createDataFrame([(i if i else None, t, "x", [1]) for i, t in enumerate(texts)] + [(3, texts[3], "y", [2])], "doc_id long, text string, n_tokens string, ids array<int>").repartition(3)
    got = bpe.digests(docs, WORD).collect()
    assert len(got) == len(texts) + 1

    def want(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert all(tuple(r)[1:] == want(texts[r["doc_id"] or 0]) for r in got)
    full = bpe.encoded(docs.filter("doc_id < 100"), WORD).collect()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in full) and len(full) == 100
    assert bpe.digests(docs.limit(0), WORD).count() == 0


def test_query(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORD)
    rows = op11_prefix_bpe(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").select("n_tokens", "ids_sha256", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert rows
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
