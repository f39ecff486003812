"""BPE encoding by per-prefix dynamic programming, and decoding.

The ids of a word's prefix end with one certain token. It is a token that the prefix ends with, and
that is compatible with the last token of what comes before: side by side, the two stay two. So an
automaton over the vocabulary gives every token that ends at a position, a test of the pair picks
the one, and it is stored for the prefix. Back-pointers from the word's end then give the ids, which
are those of merging pairs by rank, in time linear in the word.

Two tokens are compatible if no merge joins a piece of one to a piece of the other. Pieces at the
border are the right edge of one merge tree and the left edge of the other; going back in time, the
later of the two merges is undone, and each pair that stood side by side must not be a merge that
would have come first.

A tokenizer's own normaliser and splitter, from its file, cut texts into words. Where they treat runs
without blank or line end one by one, the ids and tokens of runs met before are kept for the task.

Refused with ValueError: models other than BPE, with dropout, unknown tokens, byte fallback,
prefixes of continued words or whole words before merges; merge lists in which a token has two
origins or comes before its parts; added tokens that strip, or match words or normalised text only.
A character that the vocabulary lacks raises KeyError (byte-level vocabularies have all).

Edge cases: null or empty text has no ids and decodes to an empty string. Repeated rows each have
their row. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready
from .packing import BEFORE_MARKS, WordIds, byte_letters, tokenizer_of

#: Runs that a task keeps, and characters of a run that is kept at most.
RUNS_KEPT, RUN_LENGTH = 200_000, 64
#: Tested pairs of tokens that a Python worker keeps.
PAIRS_KEPT = 1 << 18
#: Before this rank, that is always.
NEVER = 1 << 40
#: Where the code points begin that stand for a word's last letter with its suffix.
LAST = 0xF0000
_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixBpe:
    """Ids of single words."""

    def __init__(self, model: dict):
        import ahocorasick

        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"not a plain BPE model: {model.get('type')} {odd}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        # a token's letters, where a last letter and its suffix are one code point
        self.ids = {self.folded(t): i for t, i in model["vocab"].items()}
        self.rank, self.left, self.right, self.made = {}, {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.folded(a, within=True), self.folded(b)
            t = a + b
            if t in self.made or max(self.made.get(a, -1), self.made.get(b, -1)) >= r or any(len(x) > 1 and x not in self.made for x in (a, b)):
                raise ValueError(f"merge {r} makes a token anew or before its parts")
            self.rank[a, b], self.made[t], self.left[t], self.right[t] = r, r, a, b
        # tokens that their own letters never merge into don't occur
        self.automaton, sound = ahocorasick.Automaton(), {}
        for t in self.made:  # parts come first
            a, b = self.left[t], self.right[t]
            sound[t] = sound.get(a, True) and sound.get(b, True) and self.apart(a, b, self.made[t])
        self.whole = {t: [i] for t, i in self.ids.items() if len(t) == 1 or sound.get(t, False)}
        for t, (i,) in self.whole.items():
            self.automaton.add_word(t, (len(t), i, t))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def folded(self, token: str, within: bool = False) -> str:
        """The token with its suffix, if any, folded into the letter before."""
        n = len(self.suffix)
        if not n or within or not token.endswith(self.suffix) or len(token) == n:
            return token
        return token[: -n - 1] + chr(LAST + ord(token[-n - 1]))

    def apart(self, a: str, b: str, until: int = NEVER) -> bool:
        """Does no merge before rank until join a piece of a to a piece of b. Of equal ranks, the left one comes first."""
        gone_a = gone_b = until
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < gone_a and r <= gone_b and r < until:
                return False
            x, y = self.made.get(a, -1), self.made.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                gone_a, a = x, self.right[a]
            else:
                gone_b, b = y, self.left[b]

    def word(self, letters: str) -> list[int]:
        """Ids of a word's letters, which have no suffix yet."""
        if not letters:
            return []
        if self.suffix:
            letters = letters[:-1] + chr(LAST + ord(letters[-1]))
        if letters in self.whole:
            return self.whole[letters]
        last: list[tuple[int, int, str] | None] = [None] * len(letters)
        pairs = self.pairs
        for end, token in self.automaton.iter(letters):
            if last[end] is not None:
                continue
            at = end - token[0]
            if at >= 0:
                before = last[at]
                if before is None:
                    continue
                pair = (before[2], token[2])
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[pair] = self.apart(*pair)
                if not fits:
                    continue
            last[end] = token
        at, out = len(letters) - 1, []
        while at >= 0:
            if last[at] is None:
                raise KeyError(f"the vocabulary lacks letter {at} of {letters!r}")
            out.append(last[at][1])
            at -= last[at][0]
        return out[::-1]


class Runs(dict):
    """From a run to how many ids it has, and its ids and tokens joined by blanks; () where it has none. Short runs are kept."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, run: str) -> tuple:
        codec = self.codec
        if run.isalpha() and WordIds.is_plain(run):  # one word that the normaliser leaves as it is
            ids = codec.bpe.word(run if run.isascii() else run.encode().decode("latin-1").translate(codec.letters))
        else:
            ids = codec.ids(run)
        out = (len(ids), " ".join(map(str, ids)), " ".join([codec.names[i] for i in ids])) if ids else ()
        if len(run) <= RUN_LENGTH:
            if len(self) >= RUNS_KEPT:
                self.clear()
            self[run] = out
        return out


class Codec:
    """Ids and tokens of texts under a tokenizer's file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        self.tokenizer, self.by_runs = tokenizer_of(path)
        self.bpe = PrefixBpe(spec["model"])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token has conditions")
        self.added, self.names = added, self.bpe.names | {i: t for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.runs, self.letters = Runs(self), byte_letters()

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if not text:
            return []
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.pre_tokenizer is not None else [(text, None)]
        return list(chain.from_iterable(self.bpe.word(w) for w, _ in words))

    def ids(self, text: str) -> list[int]:
        if self.cut is None:
            return self.plain(text)
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.added[part]] if i % 2 else self.plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, added tokens kept: the file's decoder, or tokens joined by blanks where it has none."""
        tokens = [self.names[i] for i in ids]
        return self.tokenizer.decoder.decode(tokens) if self.tokenizer.decoder is not None else " ".join(tokens)

    def both(self, text: str) -> tuple[int, str, str]:
        """How many ids, the ids joined by blanks, and the decoded text."""
        if not self.by_runs or self.tokenizer.decoder is not None:
            ids = self.ids(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        low = text.lower()
        if any(t in text or t in low for t in self.added):
            ids = self.ids(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        if "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            # fewer kinds of runs: no capitals, and end marks apart from words, where the splitter cuts too
            text = BEFORE_MARKS.sub(" ", low)
        found = [x for x in map(self.runs.__getitem__, text.replace("\n", " ").split(" ")) if x]
        n, ids, tokens = zip(*found, strict=True) if found else ((), (), ())
        return sum(n), " ".join(ids), " ".join(tokens)


@lru_cache(1)
def codec_of(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def shipped(spark, path: str) -> str:
    """The file's name on executors, to which Spark sends it."""
    spark.sparkContext.addFile(path)
    return Path(path).name


def opened(name: str) -> Codec:
    """In a task: the codec of a sent file, with no runs kept from tasks before."""
    codec = codec_of(SparkFiles.get(name))
    codec.runs.clear()
    return codec


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded for every row of docs (doc_id, text)."""
    python_ready(docs.sparkSession)
    name = shipped(docs.sparkSession, tokenizer_path)

    def rows(batches):
        codec = opened(name)
        for b in batches:
            found = [codec.ids(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in found], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by blanks), decoded_sha256 for every row of docs (doc_id, text)."""
    python_ready(docs.sparkSession)
    name = shipped(docs.sparkSession, tokenizer_path)

    def rows(batches):
        codec = opened(name)
        for b in batches:
            counts, ids, decoded = [], [], []
            for text in b.column(1).to_pylist():
                n, x, y = codec.both(text or "")
                counts.append(n)
                ids.append(hashlib.sha256(x.encode()).hexdigest())
                decoded.append(hashlib.sha256(y.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _OUT)
