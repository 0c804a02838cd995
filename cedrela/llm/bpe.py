"""BPE encoding and decoding by an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks, pick, small_batches, table, texts

#: Characters of which every Unicode version says the same: Latin, Greek, Cyrillic, common punctuation.
SETTLED = regex.compile(r"[\x00-\u052f\u2010-\u2027\u20ac]*").fullmatch

#: Distinct words, and characters of them, of which a worker keeps the pieces before it forgets those not met since the last
#: time: bounds of its memory (twice so many), not of its results.
KEPT_WORDS, KEPT_CHARACTERS = 350_000, 6 << 20


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary (tokenizers' JSON): its pieces, merge ranks, word pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.piece = {i: t for t, i in (self.ids | self.special).items()}
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letter = byte_letters()
        self.byte = {x: i for i, x in enumerate(self.letter)}
        self.inner, self.final = [self.ids.get(x) for x in self.letter], [self.ids.get(x + self.suffix) for x in self.letter]
        self.complete = None not in self.inner and None not in self.final
        self.library = Tokenizer.from_file(path)

    def cut(self, text: str) -> list[str]:
        """The text's words. Of letters that newer Unicode versions added or changed, the library's own tables decide."""
        if text.isascii() or SETTLED(text):
            return self.words(self.normal(text))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in found]

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter: a final sigma is no special case. White space matters only as a gap."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def symbols(self, word: str) -> list[int]:
        """A word's first symbols: its bytes, the last of them with the word's end."""
        raw = word.encode()
        out = [self.inner[b] for b in raw]
        out[-1] = self.final[raw[-1]]
        return out if self.complete else [x for x in out if x is not None]

    def merged(self, words: list[str]) -> list[list[int]]:
        """The pieces of many words at once.

        All words stand in one array with a gap after each. An index holds every pair's places; the pair of the lowest
        rank that is present is merged at all of its places, from left to right, and the lists of the pairs beside each
        place are brought up to date: a place whose pair has changed is found out when its turn comes.
        """
        symbol: list[int] = []
        begin = []
        for word in words:
            begin.append(len(symbol))
            symbol += self.symbols(word)
            symbol.append(-1)
        n, rank = len(symbol), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:])):
            if pair in rank:
                places.setdefault(pair, []).append(i)
        active = [(rank[p][0], p) for p in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            left, right = pair
            made = rank[pair][1]
            fresh = set()
            for i in sorted(places.pop(pair, ())):
                j = after[i]
                if symbol[i] != left or j >= n or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = made, -2  # -2: now part of the piece before
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (new := (made, symbol[k])) in rank:
                        places.setdefault(new, []).append(i)
                        fresh.add(new)
                if (h := before[i]) >= 0 and (new := (symbol[h], made)) in rank:
                    places.setdefault(new, []).append(h)
                    fresh.add(new)
            for new in fresh:
                heapq.heappush(active, (rank[new][0], new))
        ends = [*begin[1:], n]
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(begin, ends)]


class Pieces:
    """The ids and the decoded pieces of words, as strings, kept from batch to batch and task to task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.fixed = {s: str(i) for s, i in v.special.items()}, {s: s for s in v.special}
        self.now, self.before, self.characters = ({}, {}), ({}, {}), 0

    def of(self, words: set[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Two dictionaries that hold these words: their ids and their decoded pieces. Unknown words are merged together."""
        if len(self.now[0]) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.before, self.now, self.characters = self.now, ({}, {}), 0
        ids, decoded = self.now
        ids.update(self.fixed[0])
        decoded.update(self.fixed[1])
        words = words - ids.keys()
        self.characters += sum(map(len, words))
        for word in words & self.before[0].keys():
            ids[word], decoded[word] = self.before[0][word], self.before[1][word]
        new = list(words - ids.keys())
        for word, found in zip(new, self.v.merged(new)):
            ids[word], decoded[word] = " ".join(map(str, found)), " ".join(self.v.piece[i] for i in found)
        return ids, decoded


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def encode_decode(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, one space between), decoded (the ids' pieces, one space between).

    vocabulary_file: a tokenizers JSON of a word-end BPE, with ids as that library gives with add_special_tokens=False and
    text as its decode() gives with skip_special_tokens=False. It is shipped to the executors once (its size doesn't depend
    on the corpus). Every partition is encoded by itself, without a shuffle: the distinct words of a batch that aren't known
    yet are merged together by Vocabulary.merged().

    Cases: a null text is empty; an empty text, or one without a word, has no ids and decodes to nothing. The strings of
    special tokens in a text are those tokens. Texts are processed whole, a long one in a batch of its own. Repeated rows
    are all returned; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary_file)
    name = vocabulary_file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(SparkFiles.get(name))
        known = pieces(SparkFiles.get(name))
        for batch in chunks(batches, "text", 2 << 20):
            cut = []
            for text in texts(batch):
                if v.specials and "<|" in text:
                    cut.append([w for k, part in enumerate(v.specials.split(text)) for w in ([part] if k % 2 else v.cut(part))])
                else:
                    cut.append(v.cut(text))
            ids, decoded = known.of({w for words in cut for w in words})
            out = [" ".join(map(ids.__getitem__, words)) for words in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.count(" ") + 1 if x else 0 for x in out], pa.int64()),
                    pa.array(out, pa.string()),
                    pa.array([" ".join(map(decoded.__getitem__, words)) for words in cut], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
