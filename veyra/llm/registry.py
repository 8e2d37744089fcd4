"""The queries of this subpackage, by name; each takes (spark, sf_dir). SQL in ORACLE where it can express one."""

from __future__ import annotations

from . import bpe, decontaminate, lines, neardup, reshard, secrets, suffix, topk, toxicity, warc
from .sql import ORACLE  # noqa: F401

QUERIES = {
    "op1_warc": warc.query,
    "op2_bpe": bpe.query,
    "op3_toxicity": toxicity.query,
    "op4_secrets": secrets.query,
    "op5_reshard": reshard.query,
    "op6_topk": topk.query,
    "op7_decontaminate": decontaminate.query,
    "op8_suffix": suffix.query,
    "op9_neardup": neardup.query,
    "op10_lines": lines.query,
}
