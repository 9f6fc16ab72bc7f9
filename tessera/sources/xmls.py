"""XML as a table of elements, within a budget and without document types or entities.

A task only turns each file's markup into rows, one an element; what the elements mean is left to joins and column expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.sources.delimited import Budget

#: node: the place in document order from 1; steps and places: names and nodes from the root down to the element itself;
#: spaces: the distinct namespaces on that way; whole: text with that of all elements inside; inner: first texts inside, by name.
ELEMENTS = "node int, name string, namespace string, steps array<string>, places array<int>, spaces array<string>, attributes map<string,string>, children int, whole string, inner map<string,string>, issue string"
NOTHING = (None,) * 10
#: Rows of one batch out of a task.
BATCH = 4096


@lru_cache(maxsize=4096)
def _named(tag: str) -> tuple[str, str]:
    """Local name and namespace of a tag."""
    return (tag.rsplit("}", 1)[-1], tag[1:].rsplit("}", 1)[0] if tag.startswith("{") else "")


def _attributes(node: ET.Element) -> dict[str, str | None]:
    """Attributes by local name; a name that two of them share has no value."""
    names = [_named(k)[0] for k in node.attrib]
    return {n: v if names.count(n) == 1 else None for n, v in zip(names, node.attrib.values())}


def _walk(content: bytes, budget: Budget, code: str, texts: tuple[str, ...], whole_of: str | None) -> Iterator[tuple]:
    """The elements of one file in the order in which they end; a fault is a last row with its issue."""
    if re.search(rb"<!\s*(DOCTYPE|ENTITY)", content, re.IGNORECASE) or re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", content):
        yield *NOTHING, code
        return
    # Name, namespace, names, nodes and namespaces from the root down to each open element.
    path: list[tuple[str, str, list[str], list[int], list[str]]] = [("", "", [], [], [])]
    count = held = 0
    gathering, inner = 0, {}
    try:
        content.decode("utf-8")
        for event, node in ET.iterparse(BytesIO(content), ("start", "end")):
            if event == "start":
                count += 1
                name, space = _named(node.tag)
                *_, steps, places, spaces = path[-1]
                path.append((name, space, [*steps, name], [*places, count], spaces if space in spaces else sorted({*spaces, space})))
                held += name in texts
                if name == whole_of and not gathering:
                    gathering, inner = count, {}
                if len(path) > budget.xml_depth + 1 or count > budget.xml_nodes or len(node.attrib) > budget.xml_attributes:
                    yield *NOTHING, "TABULAR_LIMIT_EXCEEDED"
                    return
                continue
            name, space, steps, places, spaces = path.pop()
            at, in_texts = places[-1], name in texts
            whole = "".join(node.itertext()) if in_texts else None if len(node) else node.text or ""
            if gathering and at != gathering and in_texts:
                if at < inner.get(name, (at + 1,))[0]:
                    inner[name] = at, whole
            else:
                yield at, name, space, steps, places, spaces, list(_attributes(node).items()) if node.attrib else [], len(node), whole, [(n, w) for n, (_, w) in inner.items()] if at == gathering else [], None
                if at == gathering:
                    gathering = 0
            held -= in_texts
            if not held:
                # Nothing above asks for its text, so the task keeps no more than an empty element of it.
                node.clear()
    except (ET.ParseError, UnicodeDecodeError, LookupError):
        yield *NOTHING, code


def elements(parts: DataFrame, budget: Budget = Budget(), code: str = "WORKBOOK_UNSAFE", texts: tuple[str, ...] = (), whole_of: str | None = None) -> DataFrame:
    """The elements of ``parts`` (any columns, ``content`` and ``issue``): the other columns and those of :data:`ELEMENTS`.

    ``whole`` is there for elements without children and for those named in ``texts``. An outermost element named ``whole_of``
    holds in ``inner`` the text of the first element of each of ``texts`` inside it; these are no rows of their own. A part
    that already has an issue is handed on as one row, and one without content is empty XML. A part is read element by element and
    its rows leave the task in batches, those before a fault too: whoever finds an issue for a part must drop its other rows.
    """
    keys = [f for f in parts.schema.fields if f.name not in ("content", "issue")]
    schema = StructType([*keys, *StructType.fromDDL(ELEMENTS).fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in keys]

    def rows(batches):
        for batch in batches:
            shared = list(zip(*(batch[n].to_pylist() for n in names), strict=True))
            issues, content = batch["issue"].to_pylist(), batch["content"]
            for i, own in enumerate(shared):
                found = [(*NOTHING, issues[i])] if issues[i] else _walk(content[i].as_py() or b"", budget, code, texts, whole_of)
                for row in found:
                    yield own + row

    def shown(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def read(batches):
        found = rows(batches)
        while out := list(islice(found, BATCH)):
            yield shown(out)

    return parts.select(*names, "content", "issue").mapInArrow(read, schema)


def attribute(name: str) -> Column:
    """The attribute of this local name, empty where there is none."""
    return F.coalesce(F.col("attributes")[name], F.lit(""))


def ambiguous(*names: str) -> Column:
    """Whether two attributes of different namespaces share one of these local names."""
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key("attributes", n) & F.col("attributes")[n].isNull())


def above(name: str) -> Column:
    """The node of the outermost element of this name on the way to an element, itself included; null where there is none."""
    return F.get("places", F.array_position("steps", name).cast("int") - 1)
