"""The registered queries of this subpackage and their SQL."""

from . import oracle
from .decontaminate import op5_benchmark_decontamination
from .language_id import op3_language_id
from .mixing import op2_mixing
from .quality_classifier import op4_quality_classifier
from .quality_rules import op6_quality_rules
from .sharding import op10_sharding
from .simhash import op8_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op7_suffix_array_dedup
from .warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_mixing,
        op3_language_id,
        op4_quality_classifier,
        op5_benchmark_decontamination,
        op6_quality_rules,
        op7_suffix_array_dedup,
        op8_simhash_near_dedup,
        op9_warc,
        op10_sharding,
    )
}
#: The others learn models, hash with XXH64, or search for cuts: they are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracle.OP1,
    "op5_benchmark_decontamination": oracle.OP5,
    "op7_suffix_array_dedup": oracle.OP7,
    "op9_warc": oracle.OP9,
}
