"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from loomgraph.llm import decontaminate, importance, lines, multiset, negatives, warc
from loomgraph.llm.decontaminate import op3_decontaminate
from loomgraph.llm.flac import op10_flac
from loomgraph.llm.importance import op11_importance
from loomgraph.llm.language import op6_language
from loomgraph.llm.lines import op8_line_dedup
from loomgraph.llm.multiset import op12_fingerprints
from loomgraph.llm.near_dups import op4_near_duplicates
from loomgraph.llm.negatives import op13_hard_negatives
from loomgraph.llm.packing import op9_pack_sequences
from loomgraph.llm.quality import op5_quality
from loomgraph.llm.secrets import op2_secrets
from loomgraph.llm.token_files import op1_token_files
from loomgraph.llm.warc import op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_secrets,
        op3_decontaminate,
        op4_near_duplicates,
        op5_quality,
        op6_language,
        op7_warc,
        op8_line_dedup,
        op9_pack_sequences,
        op10_flac,
        op11_importance,
        op12_fingerprints,
        op13_hard_negatives,
    )
}
ORACLES = {"op3_decontaminate": decontaminate.ORACLE, "op7_warc": warc.ORACLE, "op8_line_dedup": lines.ORACLE, "op11_importance": importance.ORACLE, "op12_fingerprints": multiset.ORACLE, "op13_hard_negatives": negatives.ORACLE}
