"""Cross-tokenizer alignment (operator 12): where the tokens of two tokenizers meet in the same bytes.

Texts are encoded as space + text by a byte-level BPE (A) and, with the space it adds by
itself, by a byte-fallback piece model (B). A token's place comes from its tokenizer: the
character offsets of A and the spans of B's pieces are coarse cuts; where tokens share a
character (A) or are fallback bytes (B), decoded bytes refine them. Places where both end
cut the tokens into groups; every stretch between two neighbouring ends of either side
is one link of an A and a B token.

A's words (of its split pattern) and B's runs of blanks and what follows do not depend on
their surroundings, so a worker encodes each of them once and looks it up afterwards. Texts with
a character outside Latin letters, digits and ASCII marks are encoded whole, as the
split pattern's classes are only restated for these.

*Counts.* A task cuts its texts into blocks of ``BLOCK`` bytes. A block gives its distinct
id pairs with their numbers of links, and each text its distinct pairs as numbers within
the block. Pairs are added up over all blocks by Spark, the highest count of each B id is
broadcast (B's vocabulary bounds it), and each block gets the totals of its own pairs
back. A pair comes once from a block, so the most frequent pair is no hot key; a block
holds ``BLOCK`` bytes or one text.

Defined results: texts that are null, empty, or of which either side's joined bytes differ
from space + text have no tokens, zeros and an empty digest; repeated rows count as often
as they come; null ids pass; an empty table gives an empty result; other columns are not
read, and a column ``doc_id`` or ``text`` is all the operator needs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import pieces, staged, table

#: Folder with the tokenizer files, the same on every machine, and the two files.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of a block.
BLOCK = 8 << 20
#: No more units are remembered beyond so many tokens, and no longer ones; they are encoded anew.
REMEMBERED, UNIT_CHARS = 2_500_000, 256

# The byte-level split pattern with its classes over Latin text.
_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = r" \t\n\r"
WORD = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
#: Characters for which ``WORD`` splits as the byte-level pattern does.
LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Any blank of such texts.
BLANK = re.compile(f"[{_BLANK}]")
#: A run of blanks with what follows it (and blanks that end the text, as B gives a lone blank
#: no piece); no piece holds a blank after something else.
RUN = re.compile(r" +[^ ]+(?: +\Z)?| +")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _bytes_before(text: str) -> np.ndarray:
    """Byte offset of every character and of the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))))


class ByteLevel:
    """A: ids and byte ends of the tokens of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = sorted(self.model.get_vocab().items(), key=lambda e: e[1])
        self.bytes = [bytes(alphabet[c] for c in token) if set(token) <= alphabet.keys() else token.encode() for token, _ in vocabulary]
        self.size = np.array([len(b) for b in self.bytes])
        self.line_end = self.bytes.index(b"\n")

    def units(self, text: str) -> list[str]:
        return WORD.findall(text) if LATIN.fullmatch(text) else [text]

    def apart(self, unit: str) -> bool:
        """Whether the unit is split alike between two line ends."""
        return LATIN.fullmatch(unit) is not None and BLANK.search(unit, 1) is None and not unit.isspace()

    def _cuts(self, text: str, found) -> tuple[np.ndarray, np.ndarray]:
        ids, spans = np.array(found.ids, np.int32), np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        ends = _bytes_before(text)[spans[:, 1]]
        # A token that ends inside a character, as the next one begins before that character's end.
        for i in np.flatnonzero(spans[1:, 0] < spans[:-1, 1]):
            ends[i] = (ends[i - 1] if i else 0) + self.size[ids[i]]
        return ids, ends

    def one(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        return self._cuts(unit, self.model.encode(unit, add_special_tokens=False))

    def many(self, units: list[str]) -> Encoded:
        """Units that stay apart, in one text with line ends between."""
        text = "\n".join(units)
        ids, ends = self._cuts(text, self.model.encode(text, add_special_tokens=False))
        between = ids == self.line_end
        ends = ends - np.cumsum(between)
        at = np.concatenate(([0], np.cumsum(~between)))
        upto = np.append(at[:-1][between], at[-1])
        return ids[~between], ends[~between], np.diff(upto, prepend=0)


class Pieces:
    """B: ids and byte ends of the pieces of units, which start with the blank B adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(size)))
        self.fallback = np.array([self.model.is_byte(i) for i in range(size)])
        self.bytes = [bytes([int(p[3:-1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(names, self.fallback, strict=True)]
        self.closed = not any("▁" in p.lstrip("▁") for p in names)

    def units(self, text: str) -> list[str]:
        return RUN.findall(text) if self.closed and LATIN.fullmatch(text) else [text]

    def apart(self, unit: str) -> bool:
        """Whether the unit is cut alike before another one."""
        return LATIN.fullmatch(unit) is not None and unit[-1] != " "

    def one(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(unit[1:], return_type="proto", num_threads=1).pieces
        ids = np.fromiter([p.id for p in found], np.int32)
        ends = 1 + np.fromiter([p.end for p in found], np.int64)
        for i in np.flatnonzero(self.fallback[ids]):
            ends[i] = (ends[i - 1] if i else 0) + 1
        return ids, ends

    def many(self, units: list[str]) -> Encoded:
        ids, ends = self.one("".join(units))
        last = np.cumsum([len(u.encode()) for u in units])
        return ids, ends, np.diff(np.searchsorted(ends, last, "right"), prepend=0)


class Units(dict):
    """Units by number with their tokens; encodes what it has not met."""

    def __init__(self, side: ByteLevel | Pieces):
        super().__init__()
        self.side, self.new = side, []
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)
        # By unit: place of the first token, number of tokens, bytes, whether the tokens spell it.
        self.first, self.count, self.size, self.valid = (np.zeros(0, np.int64) for _ in range(4))
        # Numbers of units and tokens that stay, and the units to go before the next batch.
        self.full, self.passing = None, []

    def _shrink(self) -> None:
        """Forgets what came after the memory was full."""
        units, tokens = self.full
        for u in self.passing:
            self.pop(u, None)
        self.passing = []
        self.ids, self.ends = self.ids[:tokens], self.ends[:tokens]
        self.first, self.count, self.size, self.valid = (x[:units] for x in (self.first, self.count, self.size, self.valid))

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self.size) + len(self.new) - 1
        return n

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The units of every text by number."""
        if self.full:
            self._shrink()
        out = []
        for text in texts:
            units = self.side.units(text)
            out.append(np.fromiter(map(self.__getitem__, units), np.int64, len(units)))
        if self.new:
            self._learn()
        return out

    def _learn(self) -> None:
        """Encodes the new units, those that stay apart in one text."""
        size = np.array([len(u.encode()) for u in self.new])
        easy = np.array([self.side.apart(u) for u in self.new])
        count, valid, first = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), np.zeros(len(size), np.int64)
        together = self._together([u for u, e in zip(self.new, easy, strict=True) if e], size[easy]) if easy.any() else None
        parts, at = [], len(self.ids)
        if together is None:
            easy[:] = False
        else:
            parts.append(together[:2])
            count[easy] = together[2]
            first[easy] = at + np.cumsum(together[2]) - together[2]
            at += len(together[0])
        for k in np.flatnonzero(~easy):
            ids, ends = self.side.one(self.new[k])
            parts.append((ids, ends))
            first[k], count[k], valid[k] = at, len(ids), self._spelled(ids) == self.new[k].encode()
            at += len(ids)
        self.ids, self.ends = (np.concatenate([old, *(p[i] for p in parts)]) for i, old in enumerate((self.ids, self.ends)))
        for name, more in (("first", first), ("count", count), ("size", size), ("valid", valid)):
            setattr(self, name, np.append(getattr(self, name), more))
        for u in self.new:
            if len(u) > UNIT_CHARS:
                del self[u]
        if self.full:
            self.passing = self.new
        elif len(self.ids) > REMEMBERED:
            self.full = len(self.size), len(self.ids)
        self.new = []

    def _spelled(self, ids: np.ndarray) -> bytes:
        of = self.side.bytes
        return b"".join([of[i] for i in ids.tolist()])

    def _together(self, units: list[str], size: np.ndarray) -> Encoded | None:
        """Tokens of the units with ends within each; none where they don't spell the units one by one."""
        ids, ends, n = self.side.many(units)
        last, upto = np.cumsum(size), np.cumsum(n)
        if len(n) != len(units) or n.min() < 1 or not np.array_equal(ends[upto - 1], last) or self._spelled(ids) != "".join(units).encode():
            return None
        return ids, ends - np.repeat(last - size, n), n

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte ends from the start of the first unit, and the number of tokens up to each unit."""
        n = self.count[numbers]
        upto = np.cumsum(n)
        at = np.repeat(self.first[numbers] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
        before = np.cumsum(self.size[numbers]) - self.size[numbers]
        return self.ids[at], self.ends[at] + np.repeat(before, n), upto


def _per_text(flags_upto: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Tokens per text from the running count by unit."""
    last = np.cumsum([len(t) for t in texts])
    upto = np.concatenate(([0], flags_upto))[last] if len(texts) else np.zeros(0, np.int64)
    return np.diff(upto, prepend=0)


@lru_cache(maxsize=1)
def aligner_of(folder: str) -> Aligner:
    """The one aligner of a worker process; its tasks share what it remembers."""
    return Aligner(folder)


class Aligner:
    """Aligned tokens of batches of texts."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = ByteLevel(f"{folder}/{BYTE_BPE}"), Pieces(f"{folder}/{PIECES}")
        self.a, self.b = Units(a), Units(b)
        self.n_b = len(b.bytes)
        # Text of a token in a digest by what follows it: , or | after A; , or ; after B.
        number = lambda side, marks: [f"{i}{m}" for m in marks for i in range(len(side.bytes))]
        self.shown = np.array(number(a, ",|") + number(b, ",;"), object)
        self.shift = (0, len(a.bytes), 2 * len(a.bytes), 2 * len(a.bytes) + len(b.bytes))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text the numbers of A tokens, B tokens, groups and links, and the digest; per
        link its text and the pair of ids as a * n_b + b."""
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        row = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in row]
        ua, ub = self.a.numbers(spaced), self.b.numbers(spaced)
        fine = [i for i in range(len(row)) if self.a.valid[ua[i]].all() and self.b.valid[ub[i]].all()]
        none = np.zeros(0, np.int64)
        if not fine:
            return counts, digests, none, none
        ua, ub, row = [ua[i] for i in fine], [ub[i] for i in fine], np.array([row[i] for i in fine])
        ids_a, end_a, upto_a = self.a.tokens(np.concatenate(ua))
        ids_b, end_b, upto_b = self.b.tokens(np.concatenate(ub))
        n_a, n_b = _per_text(upto_a, ua), _per_text(upto_b, ub)
        cuts = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        cuts = cuts[np.diff(cuts, prepend=0) > 0]
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        both = (end_a[at_a] == cuts) & (end_b[at_b] == cuts)
        text_end = end_a[np.cumsum(n_a) - 1]
        of_cut = np.searchsorted(text_end, cuts)
        n_groups = np.bincount(of_cut[both], minlength=len(row))
        counts[row] = np.stack([n_a, n_b, n_groups, np.bincount(of_cut, minlength=len(row))], 1)
        # Tokens in the order of the digest: by group, A before B.
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[at_a[both]], last_b[at_b[both]] = True, True
        ends_b, ends_a = at_b[both] + 1, at_a[both] + 1  # tokens of either side up to each group's end
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + np.concatenate(([0], ends_b))[group_a]] = ids_a + np.where(last_a, self.shift[1], self.shift[0])
        order[np.arange(len(ids_b)) + ends_a[group_b]] = ids_b + np.where(last_b, self.shift[3], self.shift[2])
        at = np.concatenate(([0], np.cumsum(n_a + n_b)))
        for k, i in enumerate(row):
            shown = "".join(self.shown[order[at[k] : at[k + 1]]].tolist())
            digests[i] = hashlib.sha256(shown[:-1].encode()).hexdigest()
        return counts, digests, row[of_cut], ids_a[at_a].astype(np.int64) * self.n_b + ids_b[at_b]


TOKENS = (
    "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, "
    "gaps array<int>, uses array<int>, slot int, pair long, links long"
)


def _block_rows(key: int, ids: list, counts: list, digests: list, text: list, pair: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its texts with their pairs by number, and its pairs."""
    n = np.concatenate(counts)
    code = (np.concatenate(pair) << 32) | np.concatenate(text)
    code.sort()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    entry = code[first]
    uses = np.diff(first, append=len(code))
    doc, of = entry & 0xFFFFFFFF, entry >> 32
    new = np.flatnonzero(np.diff(of, prepend=-1))
    slot = np.repeat(np.arange(len(new)), np.diff(new, append=len(of)))
    links = np.add.reduceat(uses, new) if len(new) else uses
    by_text = np.argsort(doc.astype(np.uint16) if len(n) <= 1 << 16 else doc, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))
    gaps = np.diff(slot[by_text], prepend=0)
    begin = at[:-1][at[:-1] < at[1:]]
    gaps[begin] = slot[by_text][begin]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.astype(np.int32)))
    given = {
        "doc_id": pa.concat_arrays(ids), **{c: pa.array(n[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
        "groups_sha256": pa.array(list(chain.from_iterable(digests)), pa.string()), "block": pa.array(np.full(len(n), key)),
        "gaps": lists(gaps), "uses": lists(uses[by_text]),
    }
    pairs = {"block": pa.array(np.full(len(new), key)), "slot": pa.array(np.arange(len(new), dtype=np.int32)), "pair": pa.array(of[new]), "links": pa.array(links)}
    for columns, rows in ((given, len(n)), (pairs, len(new))):
        yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tokenized(docs: DataFrame, folder: str = FOLDER, block: int = BLOCK) -> DataFrame:
    """Rows of texts (slot is null) and rows of blocks' pairs."""
    out = TOKENS.format(id=docs.schema["doc_id"].dataType.simpleString())
    schema = _arrow(docs.sparkSession.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(folder)
        key, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        held = ids, counts, digests, text, pair = [], [], [], [], []
        for b in pieces(batches, "text"):
            n, shown, of, pairs = aligner.align(b.column("text").to_pylist())
            for x, v in zip(held, (b.column("doc_id"), n, shown, of + rows, pairs), strict=True):
                x.append(v)
            size, rows = size + b.column("text").nbytes, rows + b.num_rows
            if size >= block:
                yield from _block_rows(key, *held, schema)
                key, size, rows = key + 1, 0, 0
                for x in held:
                    x.clear()
        if rows:
            yield from _block_rows(key, *held, schema)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block with the totals of its pairs."""
    total, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    slot = pairs.column("slot").to_numpy()
    total[slot], best[slot] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    gaps, uses = docs.column("gaps").combine_chunks(), docs.column("uses").combine_chunks()
    at = np.concatenate(([0], np.cumsum(gaps.value_lengths().to_numpy()))).astype(np.int64)
    upto = np.cumsum(gaps.flatten().to_numpy().astype(np.int64))
    start = np.concatenate(([0], upto))[at]
    of = upto - np.repeat(start[:-1], np.diff(at))
    n = uses.flatten().to_numpy().astype(np.int64)
    add = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[at]))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", add(n * best[of])).append_column("count_sum", add(n * total[of]))


def align(docs: DataFrame, folder: str = FOLDER, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): numbers of tokens, groups and links, the groups' digest, and
    how frequent its links' id pairs are in all of ``docs`` (n_best, count_sum)."""
    both = staged(tokenized(docs, folder, block))
    texts = both.filter("slot IS NULL")
    pairs = both.filter("slot IS NOT NULL").select("block", "slot", "pair", "links")
    totals = staged(pairs.groupBy("pair").agg(F.sum("links").alias("total")))
    b = F.pmod("pair", F.lit(_vocabulary(folder))).alias("b")
    # One row per id of B at most.
    highest = F.broadcast(totals.groupBy(b).agg(F.max("total").alias("_highest")))
    totals = totals.withColumn("b", b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("_highest")).cast("long").alias("best"))
    back = pairs.select(F.col("block").alias("of"), "slot", "pair").join(totals, "pair").select("of", "slot", "total", "best")
    texts = texts.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "gaps", "uses")
    ident = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {ident}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored, out)


def _vocabulary(folder: str) -> int:
    return len(Pieces(f"{folder}/{PIECES}").bytes)


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents under the two tokenizers."""
    out = align(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
