"""SentencePiece encoding and decoding: a table of distinct marked words.

White space becomes a marker before each word, and no piece of the vocabulary has a marker after another character, so a text's
ids are those of its marked words in turn (a run of markers and what follows it, up to the next marker). Documents are scanned in
blocks. Each block's distinct words go, by hash, to a part of the table, where a word is segmented once for all blocks that sent
it; its ids go back to those blocks and are laid out by the positions of its occurrences. A frequent word is one entry a block
however often it occurs, so no part is hot. The scan runs twice (words out, positions kept), over the same splits; a block whose
two scans differ finds no answer and fails.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; a repeated row is encoded
for itself; ids that are null stay null; an empty table gives an empty result; further columns of the input are ignored. `docs`
has to give the same rows in the same partitions each time, as a table that is read does.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import slots
from tidewright.llm.packed import BLOCK, blocks, gathered, pack, pack_bytes, unpack, unpack_bytes

MARKER = "▁".encode()
#: Bytes of text a part of the table is laid out for.
PART = 64 << 20
_MARKED = re.compile(rb" +[^ ]*")


@lru_cache(1)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raises where a text's ids are not those of its marked words."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    how, trained = proto.normalizer_spec, proto.trainer_spec
    if how.precompiled_charsmap or not how.add_dummy_prefix or how.remove_extra_whitespaces or not how.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("the model's normalizer does not keep words and their markers as they are")
    if any(p.type == p.USER_DEFINED or re.search("[^▁]▁", p.piece) for p in proto.pieces):
        raise ValueError("a piece of the model crosses a marker")


def marked_words(text: bytes) -> list[bytes]:
    """The text's marked words, each without its first marker; markers within are spaces."""
    if not text:
        return []
    text = text.replace(MARKER, b" ")
    if b"  " in text or text[0] == 32 or text[-1] == 32:
        return [w[1:] for w in _MARKED.findall(b" " + text)]
    return text.split(b" ")


def segmented(words: list[bytes], model: str) -> list[bytes]:
    """Each marked word's ids, as unsigned 32-bit integers."""
    sp = processor(model)
    lone = sp.encode("a ")[len(sp.encode("a")) :]  # a marker and nothing else; the library gives an empty text no marker
    return [array("I", ids if w else lone).tobytes() for w, ids in zip(words, sp.encode([w.decode("utf-8", "replace") for w in words], num_threads=1), strict=True)]


def spelled(ids: list[list[int]], model: str) -> list[bytes]:
    """What each word's ids decode to within a text, its first marker as a space."""
    sp = processor(model)
    before = sp.encode("a")
    skip = len(sp.decode(before))
    return [t[skip:].encode() for t in sp.decode([before + x for x in ids])]


def _coded(held: list[bytes], parts: int, positions: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order of their first place, each one's part, the texts' words as numbers of these, and the words of each text; the
    last two only if asked. One text's words are held at a time."""
    place: dict[bytes, int] = {}
    codes, counts = [], np.zeros(len(held), np.int64)
    for i, text in enumerate(held):
        words = marked_words(text)
        new = [w for w in dict.fromkeys(words) if w not in place]
        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        if positions:
            counts[i] = len(words)
            codes.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
    parts_of = np.fromiter((zlib.crc32(w) % parts for w in place), np.int64, len(place))
    return list(place), parts_of, np.concatenate(codes) if codes else np.zeros(0, np.int32), counts


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The operator: docs' key, `ids` (array of the text's piece ids) and `decoded` (the text they decode to)."""
    check_model(model)
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(slots(docs.sparkSession), -(-size // PART))

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, held in blocks(batches, block):
            words, parts_of, _, _ = _coded(held, parts, False)
            order = np.argsort(parts_of, kind="stable")
            cuts = np.searchsorted(parts_of[order], np.arange(parts + 1))
            sent = [(p, at, pack_bytes([words[i] for i in order[cuts[p] : cuts[p + 1]]])) for p in range(parts) if cuts[p] < cuts[p + 1]]
            if sent:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "words"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, bytes] = {}
        for batch in batches:
            for part, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = unpack_bytes(raw)
                if new := [w for w in words if w not in table]:
                    table.update(zip(new, segmented(new, model), strict=True))
                found = [table[w] for w in words]
                cols = [[part], [at], [pack(np.frombuffer(b"".join(found), "<u4"))], [pack(np.fromiter(map(len, found), np.int64, len(found)) // 4)]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "ids", "lengths"])

    kind = docs.schema[key].dataType

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, ids, held in blocks(batches, block):
            _, parts_of, codes, counts = _coded(held, parts, True)
            yield pa.record_batch([pa.array([at], pa.binary()), pa.array([ids], pa.list_(batch_type)), pa.array([pack(counts)]), pa.array([pack(codes)]), pa.array([pack(parts_of)])], names=["block", "keys", "counts", "codes", "parts_of"])

    def laid_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("the two scans dealt the documents out differently: write them as a table first")
        counts, codes, parts_of = (unpack(left.column(c)[0].as_py()) for c in ("counts", "codes", "parts_of"))
        replies = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "ids", "lengths")), strict=True), key=lambda r: r[0])
        ids = np.concatenate([np.zeros(0, np.int64), *(unpack(r[1]) for r in replies)])
        lengths = np.concatenate([np.zeros(0, np.int64), *(unpack(r[2]) for r in replies)])
        if len(lengths) != len(parts_of):
            raise RuntimeError("the two scans dealt the documents out differently: write them as a table first")
        place = np.empty(len(parts_of), np.int64)  # of a word, among the answers by part
        place[np.argsort(parts_of, kind="stable")] = np.arange(len(parts_of))
        ends = np.cumsum(lengths).tolist()
        flat = ids.tolist()
        words = spelled([flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], model)
        at = place[codes]
        of_text = np.concatenate([[0], np.cumsum(counts)])
        sums = np.concatenate([[0], np.cumsum(lengths[at])])
        found = gathered(ids, lengths, at)
        spell = words.__getitem__
        decoded = [b"".join(map(spell, at[a:b].tolist()))[1:] for a, b in zip(of_text[:-1], of_text[1:], strict=True)]
        listed = pa.ListArray.from_arrays(pa.array(sums[of_text], pa.int32()), pa.array(found, pa.int32()))
        return pa.table([left.column("keys").combine_chunks().flatten(), listed, pa.array(decoded, pa.binary()).cast(pa.string())], names=[key, "ids", "decoded"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    sent = source.mapInArrow(words_out, "part int, block binary, words binary")
    back = sent.repartition(parts, "part").mapInArrow(answered, "part int, block binary, ids binary, lengths binary")
    rows = T.StructType([T.StructField("block", T.BinaryType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("counts", "codes", "parts_of"))])
    kept = source.mapInArrow(positions, rows)
    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return kept.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(laid_out, out)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """The query's columns of encode(): counts and hashes of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
