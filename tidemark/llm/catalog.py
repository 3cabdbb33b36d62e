"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.llm import collocations, decontaminate, importance, jaccard_join, kd_shards, line_dedup, mixing, quality_rules, style_tree, suffix_tree, toxicity, transcripts, url_filter
from tidemark.session import prepare

_ALL = (
    mixing.op1_mixing, style_tree.op2_style_tree, decontaminate.op3_decontaminate, line_dedup.op4_line_dedup, transcripts.op5_transcripts,
    url_filter.op6_url_filter, quality_rules.op7_quality_rules, suffix_tree.op8_suffix_tree, toxicity.op9_toxicity, jaccard_join.op10_jaccard_join,
    importance.op11_importance, kd_shards.op12_kd_shards, collocations.op13_collocations,
)


def _prepared(fn):
    def run(spark, sf_dir):
        return fn(prepare(spark), sf_dir.rstrip("/"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {fn.__name__: _prepared(fn) for fn in _ALL}
ORACLES = {"op1_mixing": mixing.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op11_importance": importance.ORACLE, "op12_kd_shards": kd_shards.ORACLE, "op13_collocations": collocations.ORACLE}
