"""The subpackage's queries and their SQL."""

from __future__ import annotations

from kgraph.llm import licenses, linecrf, mih, mixing, packing, partenum, quality, sitetree, toxicity, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ngram_join": partenum.op3_ngram_join,
        "op4_warc": warc.op4_warc,
        "op5_nearest": mih.op5_nearest,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_quality": quality.op7_quality,
        "op8_extract": sitetree.op8_extract,
        "op9_line_rules": linecrf.op9_line_rules,
        "op10_pack": packing.op10_pack,
    }


def oracle_sql():
    return {"op1_mix_sources": mixing.ORACLE, "op4_warc": warc.ORACLE}
