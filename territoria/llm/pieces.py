"""Encoding and decoding with a piece model over a table of distinct marked words.

The piece library writes every space as a marker and puts one more before the
text. Where no piece of the model has a marker behind another character, no
merge can cross from a word to the next marker: a text's ids are then the ids
of its marked words (a run of markers and what follows up to the next one) in
order. Each task keeps a table of the distinct marked words it has met, lets
the library segment each of them once, and joins the ids back by position. The
table is keyed by the words themselves, so nothing rests on a hash. Decoding is
the library's own over a document's whole list of ids.

A model whose pieces can cross markers, or which rewrites texts before
segmenting them, is recognised from its own description; its texts are
segmented whole.

Defined cases: null and empty texts are the begin and end ids alone; a text of
blanks only is one marked word; repeated rows are encoded alike, each on its
own; an empty table gives an empty result; all columns but doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.words import text_blocks

MARKER = "▁"
#: distinct marked words that a task remembers before it starts anew, and the longest of them
MEMO, LONGEST = 300_000, 64

_WORDS = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_are_independent(processor) -> bool:
    """Whether a text's ids are the ids of its marked words in order."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    rule, trained = model.normalizer_spec, model.trainer_spec
    if (rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix
            or not rule.escape_whitespaces or trained.treat_whitespace_as_suffix):
        return False
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    if trained.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
        return False
    return not any(p.type == kind.USER_DEFINED or MARKER in p.piece.lstrip(MARKER) for p in model.pieces)


class MarkedWords(dict):
    """Marked word -> its ids as native unsigned 32-bit integers.

    A word is written with spaces for markers; it has one at least.
    """

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.independent = words_are_independent(self.library)
        self.lone = array("I", [self.library.piece_to_id(MARKER)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        # the library puts the first marker itself, but only before some text
        ids = array("I", self.library.encode(word[1:])).tobytes() if len(word) > 1 else self.lone
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """All ids, begin and end ids included."""
        if not self.independent:
            own = self.library.encode(text)
        elif text:
            own = np.frombuffer(b"".join(map(self.__getitem__, _WORDS.findall(" " + text.replace(MARKER, " ")))), np.uint32)
        else:
            own = []
        return np.concatenate([[self.library.bos_id()], own, [self.library.eos_id()]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_tables: dict[str, MarkedWords] = {}


def table_of(path: str) -> MarkedWords:
    if path not in _tables:
        _tables[path] = MarkedWords(path)
    return _tables[path]


class Encode:
    """Task function: ids and decoded text of every document, or their digests."""

    def __init__(self, path: str, digests: bool):
        self.path, self.digests = path, digests

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table_of(self.path)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_blocks(batch.column("text")):
                rows = []
                for i in range(len(offsets) - 1):
                    ids = words.encode(data[offsets[i]: offsets[i + 1]].tobytes().decode())
                    decoded = words.decode(ids)
                    out = ids.astype(np.int32), decoded
                    if self.digests:
                        out = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((doc_ids[first + i], len(ids), *out))
                kinds = [pa.string(), pa.string()] if self.digests else [pa.list_(pa.int32()), pa.string()]
                names = ["ids_sha256", "decoded_sha256"] if self.digests else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), *kinds])],
                    names=["doc_id", "n_tokens", *names])


class Decode:
    """Task function: texts of lists of ids."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table_of(self.path)
        for batch in batches:
            texts = [None if ids is None else words.library.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, model_path: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded.

    With ``digests`` the last two are replaced by ids_sha256 (little-endian
    unsigned 32-bit ids) and decoded_sha256, so that tasks return no long rows.
    """
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        Encode(model_path or default_model(), digests), f"doc_id bigint, n_tokens bigint, {last}")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text."""
    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(
        Decode(model_path or default_model()), "doc_id bigint, text string")
