"""Which tokens of two tokenizers cover the same bytes.

The tokens of a text are rows of a token-byte incidence matrix: A's tokens over the bytes, B's
tokens over the same bytes. Row products of A with the transposed B, after Gustavson, link every
pair of overlapping tokens, with the bytes they share as the entry. Byte offsets where tokens of
both end cut the tokens into groups; with incidence matrices of tokens and groups, the products
over the groups give the pairs that share one.

A text is cut before spaces that follow a sign other than white space: no token of either
tokenizer crosses such a place, so a piece has the same tokens wherever it stands. The different
pieces that a task meets are encoded once; a matrix of documents by pieces, times one of
pieces by linked ids, gives each document's links.

The documents that hold an id pair are counted over the corpus in Spark, and the counts come back
to the blocks that have the pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, read, stage
from .csr import CSR
from .registry import query

#: Where the vocabulary files lie on every machine.
FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Pieces whose text goes to a tokenizer at once, in bytes.
AT_ONCE = 1 << 16
#: Blocks in a stored file, which bounds what a reader holds.
BLOCKS_PER_FILE = 8
#: Rows whose texts are taken out of a batch at once.
SLICE = 256
#: Pieces whose alignment a task remembers from block to block; beyond them, it keeps of those that
#: several blocks had at most half as many.
REMEMBERED = 200_000
#: Fixed value: the sign that B's pieces have for a space.
SPACE = "▁"
_SPACES = re.compile(r"\s ")


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = _byte_signs()
        names = {number: name for name, number in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [
            bytes(signs.get(c, 0x3F) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        # How an id is written inside its group and at the end of it, A's and then B's.
        self.signs = [f"{i}{sign}" for i in range(len(self.bytes_a)) for sign in ",|"]
        self.signs += [f"{i}{sign}" for i in range(len(self.bytes_b)) for sign in ",;"]
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space, or nothing if either side's bytes differ."""
        # The fast call leaves out the places of the tokens in the text, which their bytes give.
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        body = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != body or b"".join(map(self.bytes_b.__getitem__, b)) != body:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _byte_signs() -> dict[str, int]:
    """The byte of each sign in the names of a byte-level vocabulary: printable Latin-1 signs stand
    for themselves, the other bytes, in order, for the signs from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def pieces_of(text: str) -> list[str]:
    """Space + text, cut before each space that follows a sign other than white space."""
    parts = text.split(" ")
    if not text.startswith(" ") and not _SPACES.search(text):
        return [" " + p for p in parts]
    out, held = [], ""
    for p in parts:
        held += " " + p
        if p and not p[-1].isspace():
            out.append(held)
            held = ""
    return [*out, held] if held else out


class Alignment:
    """Tokens, links and groups of a list of texts that each begin with a space and end where tokens
    of both tokenizers end."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str], ids_a: np.ndarray, ids_b: np.ndarray):
        self.ids_a, self.ids_b, self.n = ids_a, ids_b, len(texts)
        self.signs, self.first_b = tokenizers.signs, len(tokenizers.bytes_a)
        length_a, length_b = tokenizers.length_a[ids_a], tokenizers.length_b[ids_b]
        bytes_a, bytes_b = CSR.runs(length_a), CSR.runs(length_b)
        self.ends = np.cumsum([len(t.encode()) for t in texts], dtype=np.int64)
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        self.text_a = np.searchsorted(self.ends, end_a)
        self.text_b = np.searchsorted(self.ends, end_b)
        # Each byte lies in one token of B, so this is B's matrix transposed.
        by_byte = CSR.one_per_row(bytes_b.rows(), len(ids_b))
        self.overlaps = bytes_a.times(by_byte)
        at = np.searchsorted(end_b, end_a)
        cuts = end_a[end_b[at] == end_a] if len(end_b) else end_a
        self.n_groups, self.text_of_group = len(cuts), np.searchsorted(self.ends, cuts)
        self.groups_a = CSR.one_per_row(np.searchsorted(cuts, end_a), len(cuts))
        self.groups_b = CSR.one_per_row(np.searchsorted(cuts, end_b), len(cuts))

    def shared(self) -> CSR:
        """Pairs of tokens in one group: A's token-group matrix times B's transposed. A group of
        m and n tokens gives m * n entries; counts of them need no such product (``n_shared``)."""
        return self.groups_a.times(self.groups_b.transposed())

    def per_text(self) -> dict[str, np.ndarray]:
        """Tokens, groups, links and pairs sharing a group of each text."""
        count = np.bincount
        in_a = CSR.summed(self.text_a, self.groups_a.indices, np.ones(len(self.ids_a), dtype=np.int64),
                          self.n, self.n_groups)
        in_b = count(self.groups_b.indices, minlength=self.n_groups)
        link_row = self.overlaps.rows()
        return {
            "n_a": count(self.text_a, minlength=self.n), "n_b": count(self.text_b, minlength=self.n),
            "n_groups": count(self.text_of_group, minlength=self.n),
            "n_links": count(self.text_a[link_row], minlength=self.n),
            "n_shared": in_a.times_vector(in_b),
        }

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, A's id and B's id of every link."""
        row = self.overlaps.rows()
        return self.text_a[row], self.ids_a[row], self.ids_b[self.overlaps.indices]

    def written(self) -> list[str]:
        """The groups of each text: ``a1,a2|b1;a3|b2,b3``."""
        code = np.concatenate([
            2 * self.ids_a + _last(self.groups_a.indices),
            2 * (self.ids_b + self.first_b) + _last(self.groups_b.indices)])
        group = np.concatenate([2 * self.groups_a.indices, 2 * self.groups_b.indices + 1])
        order = np.argsort(group, kind="stable")
        signs = list(map(self.signs.__getitem__, code[order].tolist()))
        text = np.sort(np.concatenate([self.text_a, self.text_b]))
        at = np.searchsorted(text, np.arange(self.n + 1)).tolist()
        # The last group of a text is followed by nothing.
        return ["".join(signs[at[i]:at[i + 1]])[:-1] for i in range(self.n)]


def _last(group: np.ndarray) -> np.ndarray:
    """1 where the next token belongs to another group."""
    return np.append(group[1:] != group[:-1], np.ones(min(1, len(group)), dtype=bool)).astype(np.int64)


def encode_pieces(tokenizers: Tokenizers, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of all pieces, some thousand of them at a time as one text; nothing if bytes differ."""
    found, held, size = [], [], 0
    for i, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece)
        if size >= AT_ONCE or i == len(pieces) - 1 or pieces[i][-1].isspace():
            ids = tokenizers.encode("".join(held))
            if ids is None:
                return None
            found.append(ids)
            held, size = [], 0
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Pieces:
    """What a task knows of the pieces that it has met, and in how many blocks it met each."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.written: list[str] = []
        self.sums = {name: np.zeros(0, dtype=np.int64) for name in _SUMS}
        self.starts, self.pairs = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int64)

    def keep_common(self, most: int) -> None:
        """Forget all but the pieces that several blocks had, of those the ``most`` common ones."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[:most]])
        names, length = list(self.number), np.diff(self.starts)[kept]
        written, sums, met = [self.written[i] for i in kept.tolist()], self.sums, self.met
        pairs = self.pairs[self._places(kept)]
        self.forget()
        self.number.update((names[i], n) for n, i in enumerate(kept.tolist()))
        self.written, self.met = written, met[kept]
        self.sums = {name: values[kept] for name, values in sums.items()}
        self.starts, self.pairs = np.concatenate([[0], np.cumsum(length)]), pairs

    def _places(self, used: np.ndarray) -> np.ndarray:
        """Where the id pairs of the pieces asked for lie, piece by piece."""
        length = np.diff(self.starts)[used]
        first = np.repeat(self.starts[used] - (np.cumsum(length) - length), length)
        return first + np.arange(len(first))

    def learn(self, pieces: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> None:
        """Align new pieces, which are numbered on from those that are known."""
        alignment = Alignment(self.tokenizers, pieces, ids_a, ids_b)
        self.written += alignment.written()
        for name, values in alignment.per_text().items():
            self.sums[name] = np.concatenate([self.sums[name], values])
        _, a, b = alignment.links()
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(self.sums["n_links"][len(self.starts) - 1:])])
        self.pairs = np.concatenate([self.pairs, (a << 32) | b])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), dtype=np.int64)])

    def links(self, used: np.ndarray) -> tuple[CSR, np.ndarray]:
        """Pieces by id pairs, of the pieces asked for, and the pairs."""
        length = np.diff(self.starts)[used]
        row = np.repeat(np.arange(len(used)), length)
        pairs, col = np.unique(self.pairs[self._places(used)], return_inverse=True)
        return CSR.counted(row, col, len(used), len(pairs)), pairs


def align_block(known: Pieces, texts: list[str]) -> dict:
    """Everything known of a block before the corpus is counted.

    ``texts`` are not empty. Matrices are documents by pieces (``d_*``) and pieces by id pairs
    (``l_*``); ``pairs`` are the pairs, A's id in the high half, and ``held`` the documents of the
    block that have each.
    """
    if len(known.number) > REMEMBERED:
        known.keep_common(REMEMBERED // 2)
    before = len(known.number)
    # B reads the sign of its spaces as one, so its bytes differ from the text.
    cut = [[] if SPACE in t else pieces_of(t) for t in texts]
    places = [np.fromiter(map(known.number.__getitem__, c), dtype=np.int64, count=len(c)) for c in cut]
    new = list(islice(known.number, before, None))
    ids = encode_pieces(known.tokenizers, new)
    if ids is None:
        # Some text has other bytes as tokens: ask for each document by itself.
        known.forget()
        known = Pieces(known.tokenizers)
        whole = [None if SPACE in t else known.tokenizers.encode(" " + t) for t in texts]
        new = [" " + t for t, w in zip(texts, whole) if w is not None]
        number = iter(range(len(new)))
        places = [np.array([] if w is None else [next(number)], dtype=np.int64) for w in whole]
        none = [np.zeros(0, dtype=np.int64)]
        ids = tuple(np.concatenate([w[i] for w in whole if w is not None] or none) for i in (0, 1))
    known.learn(new, *ids)
    row = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    used, col = np.unique(np.concatenate(places or [np.zeros(0, dtype=np.int64)]), return_inverse=True)
    known.met[used] += 1
    documents = CSR.counted(row, col, len(texts), len(used))
    links, pairs = known.links(used)
    held = np.bincount(documents.times(links).indices, minlength=len(pairs))
    sums = {name: documents.times_vector(values[used]) for name, values in known.sums.items()}
    digests = [
        hashlib.sha256(";".join(map(known.written.__getitem__, p.tolist())).encode()).hexdigest() if len(p) else ""
        for p in places]
    return {
        "pairs": pairs, "held": held, "d_starts": documents.indptr, "d_cols": documents.indices,
        "d_data": documents.data, "l_starts": links.indptr, "l_cols": links.indices, "l_data": links.data,
        "sums": sums, "digests": digests,
    }


_MATRICES = {"pairs": "long", "held": "int", "d_starts": "int", "d_cols": "int", "d_data": "int",
             "l_starts": "int", "l_cols": "int", "l_data": "int"}


def aligned_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER,
                   file_a: str = FILE_A, file_b: str = FILE_B, block_bytes: int = BLOCK) -> DataFrame:
    """Stored: a row per block of documents, its matrices and what is known of its documents."""
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType
    doc = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in _SUMS],
                        T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType([
        T.StructField("block", T.LongType()),
        *[T.StructField(n, T.ArrayType(T._parse_datatype_string(t))) for n, t in _MATRICES.items()],
        T.StructField("docs", T.ArrayType(doc)),
    ])
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            known = known or Pieces(Tokenizers(os.path.join(folder, file_a), os.path.join(folder, file_b)))
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if held and size + len(body or "") > block_bytes:
                        yield block(known, number, held)
                        number, held, size = number + 1, [], 0
                        give_back()
                    held.append((key, body))
                    size += len(body or "")
        if held:
            yield block(known, number, held)
        known = None
        give_back()

    def block(known, number, held):
        filled = [(i, body) for i, (_, body) in enumerate(held) if body]
        found = align_block(known, [body for _, body in filled])
        # Documents without tokens are empty rows of the first matrix.
        starts = np.zeros(len(held) + 1, dtype=np.int64)
        starts[[i + 1 for i, _ in filled]] = np.diff(found["d_starts"])
        found["d_starts"] = np.cumsum(starts)
        docs = [{"doc_id": key, **dict.fromkeys(_SUMS, 0), "groups_sha256": ""} for key, _ in held]
        sums = {name: v.tolist() for name, v in found["sums"].items()}
        for at, (i, _) in enumerate(filled):
            docs[i] |= {name: v[at] for name, v in sums.items()} | {"groups_sha256": found["digests"][at]}
        values = [[number], *[[found[n]] for n in _MATRICES], [docs]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    frame = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    # Spark's reader takes all blocks of a file at once.
    return stage(frame.mapInArrow(build, schema), compression="zstd", maxRecordsPerFile=BLOCKS_PER_FILE)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Stored: id pairs (``pair``, ``a_id``, ``b_id``), the documents that hold each linked
    (``docs``), and whether no other pair of its A id is held by more (``best``)."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("docs"))
    pairs = stage(pairs.withColumn("a_id", F.shiftright("pair", 32).cast("int"))
                  .withColumn("b_id", F.col("pair").bitwiseAND((1 << 32) - 1).cast("int")))
    most = pairs.groupBy("a_id").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a_id").select(
        "pair", "a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER,
          file_a: str = FILE_A, file_b: str = FILE_B, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and
    n_shared, the pairs of tokens in one group.

    A null or empty text, or one whose tokens' bytes are not those of space + text, has zeros and
    an empty digest. Repeated rows count one by one; an empty table gives an empty result; other
    columns are not looked at.
    """
    blocks = aligned_blocks(docs, doc_id, text, folder, file_a, file_b, block_bytes)
    asked = blocks.select("block", F.posexplode("pairs").alias("local", "pair"))
    # A pair comes once a block, so none has more than the share of one of a block's pairs.
    answered = asked.join(pair_counts(blocks).select("pair", "docs", "best"), "pair")
    scores = answered.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("local", "docs", "best"))).alias("s")
    ).select("block", F.col("s.docs").alias("docs_of"), F.col("s.best").alias("best_of"))
    matrices = [n for n in _MATRICES if n not in ("pairs", "held")]
    joined = blocks.select("block", *matrices, "docs").join(scores, "block", "left")
    kind = joined.schema["docs"].dataType.elementType
    schema = T.StructType([*kind.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                def numbers(name):
                    value = batch.column(name)[i]
                    return np.asarray(value.values.to_numpy(zero_copy_only=False), dtype=np.int64) if value.is_valid \
                        else np.zeros(0, dtype=np.int64)

                docs_of, best_of = numbers("docs_of"), numbers("best_of")
                links = CSR(numbers("l_starts"), numbers("l_cols"), numbers("l_data"), len(docs_of))
                documents = CSR(numbers("d_starts"), numbers("d_cols"), numbers("d_data"), links.height)
                columns = [documents.times_vector(links.times_vector(v)) for v in (best_of, docs_of)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.column("docs")[i].values.flatten(), *map(pa.array, columns)], schema=arrow)

    return joined.mapInArrow(score, schema).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
