"""The few-shot prompt: fixed text built once, completed per row as a column."""

from __future__ import annotations

import json
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.schemas import EXTRACTIONS

INSTRUCTION = """\
# Task

Split the radiology report into labelled extractions. Copy every extraction word for
word from the report and keep the order of the report.

Classes: findings_prefix for what comes before the findings (examination, indication,
technique, comparison), findings_body for single findings, findings_suffix for the
conclusion. Give each finding its organ in the attribute "section" and one of normal,
minor, significant, not_applicable in the attribute "clinical_significance".

Answer with a JSON object whose key "extractions" holds the list.

# Examples

{examples}

{inference}
"""

# An example, and the report to work on.
_EXAMPLE = """\
<example number="{number}">
<report>
{text}
</report>
<answer>
{output}
</answer>
</example>"""
_BETWEEN = "\n\n"
_INFERENCE_HEAD = "\n# Your report\n\n<report>\n"
_INFERENCE_TAIL = "\n</report>\n\nGive the answer as in the examples, without the tags.\n"
_SHOWN = ("extraction_class", "extraction_text", "attributes")


def load_examples() -> list[dict]:
    """The example reports with their extractions."""
    source = files("reportlake").joinpath("data/examples.json")
    return json.loads(source.read_text(encoding="utf-8"))


def examples_frame(spark: SparkSession, examples: Iterable[dict] | None = None) -> DataFrame:
    """The examples as rows (text, extractions)."""
    rows = [(e["text"], json.dumps(e["extractions"])) for e in examples or load_examples()]
    raw = spark.createDataFrame(rows, "text string, extractions string")
    return raw.withColumn("extractions", F.from_json("extractions", EXTRACTIONS))


def _examples_text(examples: Iterable[dict]) -> str:
    """Answers show the fields a model has to give, where an example has them."""
    shown = []
    for number, example in enumerate(examples, 1):
        found = [{f: e[f] for f in _SHOWN if e.get(f)} for e in example["extractions"]]
        output = json.dumps({"extractions": found}, indent=1, ensure_ascii=False)
        shown.append(_EXAMPLE.format(number=number, text=example["text"], output=output))
    return _BETWEEN.join(shown)


def prompt_text(examples: Iterable[dict], input_text: str | None = None) -> str:
    inference = f"{_INFERENCE_HEAD}{input_text}{_INFERENCE_TAIL}" if input_text else ""
    return INSTRUCTION.format(examples=_examples_text(examples), inference=inference)


def prompt_column(text: Column, examples: Iterable[dict] | None = None) -> Column:
    """The prompt of every row: constant head and tail around the row's text."""
    before, after = INSTRUCTION.split("{inference}")
    shown = _examples_text(load_examples() if examples is None else examples)
    head = before.format(examples=shown) + _INFERENCE_HEAD
    return F.concat(F.lit(head), text, F.lit(_INFERENCE_TAIL + after))
