"""Personal information in free text: found by a skip-chain conditional random field, replaced by placeholders.

Texts inside JSON columns are cut out by the core's structural index, candidates come from wide grammars, and
the field of `pii_field` labels the candidates of a text jointly. Everything happens inside one Arrow map over
the rows, without a shuffle; the fitted weights (a few thousand numbers) travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.functions.json_index import ARR, OBJ, STRING, JsonIndex, index
from tarnwork.llm.pii_field import Field
from tarnwork.llm.pii_training import trained
from tarnwork.operators.nested import unwrap_twice_encoded
from tarnwork.runtime import arrow_map

#: Characters of texts whose candidates make one graph, and rows that are read at a time.
PORTION, ROWS = 1 << 20, 2000
#: Placeholder of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}


def message_texts(ix: JsonIndex) -> tuple[list[int], list[str], list[str]]:
    """Row number, path and text of a message's text: `content` that is one string, or its text blocks."""
    member = ix.member(["content", "type", "text"])
    top = np.flatnonzero((ix.lev == 0) & (ix.cls == OBJ))
    value = member["content"][top]
    kind = np.where(value >= 0, ix.cls[np.maximum(value, 0)], -1)
    single = value[kind == STRING]
    blocks = np.flatnonzero((ix.cls == OBJ) & (ix.lev == 2) & (ix.parent >= 0))
    lists = np.zeros(len(ix.pos) + 1, bool)
    lists[value[kind == ARR]] = True
    blocks = blocks[lists[ix.parent[blocks]]]
    kinds, texts = member["type"][blocks], member["text"][blocks]
    is_string = lambda t: (t >= 0) & (ix.cls[np.maximum(t, 0)] == STRING)
    both = is_string(kinds) & is_string(texts)
    blocks, kinds, texts = blocks[both], kinds[both], texts[both]
    ids, names = ix.coded(kinds)
    wanted = ids == (names.index("text") if "text" in names else -1)
    blocks, texts = blocks[wanted], texts[wanted]
    paths = ["message.content"] * len(single) + [f"message.content[{k}].text" for k in ix.place[blocks].tolist()]
    tokens = np.r_[single, texts]
    return ix.doc[tokens].tolist(), paths, ix.texts(tokens)


def stdout_texts(ix: JsonIndex) -> tuple[list[int], list[str], list[str]]:
    """Row number, path and text of a tool result's `stdout`."""
    top = np.flatnonzero((ix.lev == 0) & (ix.cls == OBJ))
    value = ix.member(["stdout"])["stdout"][top]
    value = value[value >= 0]
    value = value[ix.cls[value] == STRING]
    return ix.doc[value].tolist(), ["tool_use_result.stdout"] * len(value), ix.texts(value)


def _fields(batch: pa.RecordBatch) -> tuple[list[int], list[str], list[str]]:
    rows, paths, texts = message_texts(index(unwrap_twice_encoded(batch.column(1))))
    more = stdout_texts(index(batch.column(2)))
    ids = batch.column(0).to_pylist()
    return [ids[r] for r in rows + more[0]], paths + more[1], texts + more[2]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """Fields of the batches by portions of bounded text, each of which makes one graph; a longer text is one alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            ids, paths, texts = _fields(batch.slice(at, ROWS))
            begin = size = 0
            for k, text in enumerate(texts):
                if k > begin and size + len(text) > PORTION:
                    yield ids[begin:k], paths[begin:k], texts[begin:k]
                    begin, size = k, 0
                size += len(text)
            yield ids[begin:], paths[begin:], texts[begin:]


def _narrow(df: DataFrame) -> DataFrame:
    return df.selectExpr("CAST(line_id AS bigint) AS line_id", "CAST(message AS string) AS message", "CAST(tool_use_result AS string) AS tool_use_result")


def find_personal(df: DataFrame, *, field: Field | None = None) -> DataFrame:
    """One row per distinct personal item of a text field of the transcript lines in `df`.

    Columns `line_id`, `field_path`, `pii_kind`, `found_text` (the decoded text as it stands). Null, empty and
    invalid JSON holds no text; a message encoded twice is read as the inner JSON. Repeated rows give repeated
    results; other columns of `df` don't matter. Texts are taken whole, whatever their length.
    """
    model = field or trained()
    schema = pa.schema([("line_id", pa.int64()), ("field_path", pa.string()), ("pii_kind", pa.string()), ("found_text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, paths, texts in _portions(batches):
            items = model.find(texts)
            rows = [(i, p, k, t) for i, p, text, found in zip(ids, paths, texts, items) for k, t in dict.fromkeys((kind, text[c.start : c.end]) for c, kind in found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(4)], schema=schema)

    return arrow_map(_narrow(df), scan, "line_id bigint, field_path string, pii_kind string, found_text string")


def mask_text(text: str, model: Field) -> str:
    """`text` with a placeholder of its kind in place of each item, all else unchanged."""
    (found,) = model.find([text])
    return _masked(text, found)


def _masked(text: str, found: list) -> str:
    parts, at = [], 0
    for c, kind in found:
        parts += [text[at : c.start], PLACEHOLDERS[kind]]
        at = c.end
    return "".join([*parts, text[at:]])


def mask_personal(df: DataFrame, *, field: Field | None = None) -> DataFrame:
    """Every text field of the transcript lines with placeholders for personal items, and their number.

    Columns `line_id`, `field_path`, `masked_text`, `n_items`; fields without items come out unchanged.
    """
    model = field or trained()
    schema = pa.schema([("line_id", pa.int64()), ("field_path", pa.string()), ("masked_text", pa.string()), ("n_items", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, paths, texts in _portions(batches):
            items = model.find(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array([_masked(t, f) for t, f in zip(texts, items)], pa.string()), pa.array([len(f) for f in items], pa.int32())], schema=schema)

    return arrow_map(_narrow(df), scan, "line_id bigint, field_path string, masked_text string, n_items int")
