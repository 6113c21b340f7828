"""Schemas of the relations that the operators read and write."""

from __future__ import annotations

SOURCE_QA = "uid int, NNQT_question string, question string, paraphrased_question string, sparql_wikidata string, sparql_dbpedia18 string, template string, subgraph string, template_index int, template_id string, answer array<string>"
TEXTS = "uid int, question string"
QUESTION_IDS = "uid int, ids array<string>"
LABELS = "id string, labels array<string>"
BINDINGS = "array<struct<id: struct<value: string>, label: struct<value: string>>>"
RESPONSE = f"struct<results: struct<bindings: {BINDINGS}>>"
PAIRS = "uid int, q string, a string"
PARALLEL = "part string, idx bigint, nl string, ql string"
ENCODED = "idx bigint, inp_ids array<int>, inp_att_mask array<int>, out_ids array<int>, out_att_mask array<int>"
BEAM_STEPS = "seq bigint, step int, beam int, logprobs array<double>"
LANGUAGES, SPLITS, STAGES = ("en", "nl"), ("train", "test"), ("train", "validate", "test")


def choice(value: str, allowed: tuple[str, ...]) -> str:
    """``value`` if it is one of an enumeration's names."""
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


def boolean(value: str) -> bool:
    """True, true, T, t and their opposites."""
    if value in ("True", "true", "T", "t"):
        return True
    if value in ("False", "false", "F", "f"):
        return False
    raise ValueError(f"{value!r} is no boolean")
