"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import decontam, jaccard, mixing, repair, sharding, simhash, suffixes
from .align import op13_align
from .decontam import op3_decontam
from .extract import op1_extract
from .jaccard import op10_jaccard
from .jpeg import op6_media
from .langid import op4_langid
from .mixing import op8_mixing
from .pii import op2_pii
from .quality import op7_quality
from .repair import op11_repair
from .sharding import op9_sharding
from .simhash import op12_simhash
from .suffixes import op5_repeats


def queries() -> dict:
    return {
        "op1_extract": op1_extract,
        "op2_pii": op2_pii,
        "op3_decontam": op3_decontam,
        "op4_langid": op4_langid,
        "op5_repeats": op5_repeats,
        "op6_media": op6_media,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_sharding": op9_sharding,
        "op10_jaccard": op10_jaccard,
        "op11_repair": op11_repair,
        "op12_simhash": op12_simhash,
        "op13_align": op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontam": decontam.SQL,
        "op5_repeats": suffixes.SQL,
        "op8_mixing": mixing.SQL,
        "op9_sharding": sharding.SQL,
        "op10_jaccard": jaccard.SQL,
        "op11_repair": repair.SQL,
        "op12_simhash": simhash.SQL,
    }
