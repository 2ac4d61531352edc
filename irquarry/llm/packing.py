"""First-fit decreasing in randomised groups, with a tournament tree over the bins' free room.

Documents are cut into pieces of one sequence at most.  Pieces are dealt to groups by a hash of
(document, position of the piece), so groups hold about ``group_pieces`` pieces whatever the data; each
group is packed alone, largest piece first, into the first bin with room.  The tree keeps the
largest room below each node, so a piece finds its bin in log(bins) steps.

Null text counts as empty; a document has at least its end token, so each gives a piece.  Repeated rows
are separate documents.  An empty table gives an empty result.  Pieces of equal length go by row number.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irquarry.llm.common import named, sliced, texts

SEQUENCE_LENGTH = 2048
END_TOKEN = 1
GROUP_PIECES = 4096
#: Bytes of text a piece stands for in the estimate of the number of groups.
BYTES_PER_PIECE = 4 * SEQUENCE_LENGTH

# A run of so many characters without white space, or of white space, is left to the slower
# tokenizer, whose time does not grow with the square of the run.
_LONG_RUN = re.compile(rb"[^\x20\x09-\x0D]{2000}|[\x20\x09-\x0D]{2000}")

PIECES = "doc_id {id}, row_key long, start long, length int, doc_tokens long, ids binary"
PACKED = "doc_id {id}, start long, length int, doc_tokens long, ids array<int>, sequence_id long, offset int"


def byte_bpe() -> dict[str, str]:
    """Files of the default vocabulary: merge ranks, and the same vocabulary as a tokenizer file."""
    return {
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
    }


@lru_cache(maxsize=2)
def _fast(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _steady(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_ids(body: bytes, vocabulary: dict[str, str]) -> np.ndarray:
    """Token ids of a text.  Both libraries hold the same vocabulary and give the same ids."""
    text = body.decode("utf-8", "replace")
    if _LONG_RUN.search(body):
        ids = _steady(vocabulary["tokenizer"]).encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=np.uint32)
    return _fast(vocabulary["ranks"]).encode_to_numpy(text).astype(np.uint32, copy=False)


def cut(
    docs: DataFrame, doc_id: str, text: str, length: int, end_token: int, vocabulary: dict[str, str]
) -> DataFrame:
    """Pieces of at most ``length`` ids: every document's ids with the end token, in order.

    ``ids`` are little-endian, 2 bytes each: the shuffle of the packing carries nothing larger.
    """
    from pyspark.sql.types import StructType

    kind = docs.schema[doc_id].dataType
    schema = StructType.fromDDL(PIECES.format(id=kind.simpleString()))
    rows = docs.select(
        named(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), named(text).alias("body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2):
                at, starts, sizes, totals, ids = [], [], [], [], []
                for i, body in enumerate(texts(part.column(2))):
                    found = np.append(token_ids(body or b"", vocabulary), np.uint32(end_token))
                    narrow = found.astype("<u2")
                    if not np.array_equal(narrow, found):
                        raise ValueError("token ids above 65535")
                    for start in range(0, len(found), length):
                        piece = narrow[start : start + length]
                        at.append(i)
                        starts.append(start)
                        sizes.append(len(piece))
                        totals.append(len(found))
                        ids.append(piece.tobytes())
                taken = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(taken),
                        part.column(1).take(taken),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(totals, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=schema.fieldNames(),
                )

    return rows.mapInArrow(run, schema)


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each size: the first with room.  A tournament tree holds the largest room below each node."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * leaves)
    bins = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins.append(node - leaves)
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE_LENGTH,
    end_token: int = END_TOKEN,
    group_pieces: int = GROUP_PIECES,
    vocabulary: dict[str, str] | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    The only shuffle carries the pieces, once.
    """
    from pyspark.sql.types import StructType

    pieces = cut(docs, doc_id, text, length, end_token, vocabulary or byte_bpe())
    expected = docs.agg(
        F.sum(F.floor(F.coalesce(F.octet_length(named(text)), F.lit(0)) / BYTES_PER_PIECE) + 1)
    ).head()[0]
    groups = int((expected or 0) // group_pieces) + 1
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row_key", "start", F.lit(seed)), F.lit(groups)))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = StructType.fromDDL(PACKED.format(id=kind))

    def fill(group: pa.Table) -> pa.Table:
        number = group["pack_group"][0].as_py()
        group = group.sort_by([("length", "descending"), ("row_key", "ascending"), ("start", "ascending")])
        sizes = group["length"].to_pylist()
        bins = first_fit(sizes, length)
        used: dict[int, int] = {}
        offsets = []
        for size, place in zip(sizes, bins):
            offsets.append(used.get(place, 0))
            used[place] = offsets[-1] + size
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), dtype="<u2").astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table(
            [
                group["doc_id"],
                group["start"],
                group["length"],
                group["doc_tokens"],
                pa.ListArray.from_arrays(bounds, ids),
                pa.array([(number << 32) + b for b in bins], pa.int64()),
                pa.array(offsets, pa.int32()),
            ],
            names=schema.fieldNames(),
        )

    return dealt.groupBy("pack_group").applyInArrow(fill, schema)
