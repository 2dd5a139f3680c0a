"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split where no token can cross: at ASCII blanks, for tokenizers
that drop white space between words. Pieces go to the library in batches
balanced by their UTF-8 bytes, and only the lengths of their encodings are kept. A piece
that a batch holds often is encoded once and remembered, up to a bound; a text's
other pieces are encoded together.
"""

from __future__ import annotations

import re
from collections import Counter as Seen
from collections.abc import Iterable, Iterator
from itertools import repeat
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.common import once, ship_code

#: Bytes of pieces that go to the library at a time, and pieces that a worker remembers.
BATCH_BYTES = 1 << 20
MEMORY = 300_000
#: A piece is remembered if a batch holds it so often and it is no longer than this.
OFTEN, LONGEST = 3, 64
#: Bytes after which the words of a text are split, and characters of a text that are held as words at a time.
LONG_TEXT, SECTION = 1 << 16, 1 << 20
BLANK = re.compile(r"[ \n\t\r]")


def n_bytes(piece: str) -> int:
    """Of its UTF-8 form; ASCII needs no encoding to be measured."""
    return len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))


def batches_by_bytes(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Pieces in order, in batches of at most limit bytes; a longer one is alone."""
    batch: list[str] = []
    held = 0
    for piece in pieces:
        size = n_bytes(piece)
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """A text in parts of about size characters, cut at ASCII blanks only; a word without end stays whole."""
    at = 0
    while len(text) - at > size and (blank := BLANK.search(text, at + size)):
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:] if at else text


class Counter:
    """Counts the tokens of texts with the tokenizers library.

    splits_at_blanks: whether the tokenizer drops white space and never joins
    across it, so that the count of a text is the sum over its pieces.
    """

    def __init__(self, tokenizer_json: str, splits_at_blanks: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splits = splits_at_blanks
        self.known: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> list[int]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [len(x.ids) for batch in batches_by_bytes(pieces) for x in encode(batch, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._encode(texts)
        if any(len(t) > SECTION for t in texts):
            return [sum(sum(self._count([part])) for part in sections(t)) for t in texts]
        return self._count(texts)

    def _count(self, texts: list[str]) -> list[int]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        rest = [[p for p in pieces if p not in known] for pieces in split]
        often = [p for p, n in Seen(p for pieces in rest for p in pieces).items() if n >= OFTEN and len(p) <= LONGEST]
        if len(known) + len(often) <= MEMORY:
            known.update(zip(often, self._encode(often)))
        totals, parts, owners = [], [], []
        for i, (pieces, new) in enumerate(zip(split, rest)):
            totals.append(sum(map(known.get, pieces, repeat(0))))
            for group in batches_by_bytes([p for p in new if p not in known], LONG_TEXT):
                parts.append(" ".join(group))
                owners.append(i)
        for i, n in zip(owners, self._encode(parts)):
            totals[i] += n
        return totals


def drops_blanks(tokenizer_json: str) -> bool:
    """Whether an ASCII blank is always a safe boundary, from the tokenizer's own definition.

    So it is where all white space becomes a blank, and the words that remain are
    cut out by a pattern whose parts take no white space.
    """
    import json

    told = json.loads(tokenizer_json)
    normal = (told.get("normalizer") or {}).get("normalizers", [])
    squeezes = any(n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in normal)
    parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = parts[0] if parts else {}
    cuts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", "")
    blank_free = " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    simple = {n["type"] for n in normal} <= {"NFC", "Replace", "Lowercase"}
    return bool(squeezes and cuts and blank_free and simple and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, for each row of docs (doc_id, text).

    Counts are those of the library without truncation, padding or added special
    tokens; special strings inside texts are taken as it takes them by default.
    A null text counts as empty; repeated rows each return; ties don't arise; an
    empty table gives no rows. Very long texts are counted in full, in sections cut
    at blanks where the tokenizer allows it. Other columns are not read. The
    tokenizer's file is read here and sent along, a fixed size.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    key = f"token counter {uuid4()}"
    safe = drops_blanks(definition.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(key, lambda: Counter(definition.value, safe))
        for batch in batches:
            counts: list[int] = []
            for texts in batches_by_bytes(x.as_py() for x in batch.column("text")):
                counts += counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
