"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from .divergence import OP13_SQL, op13_divergence
from .language_id import op10_language_id
from .licenses import op5_licenses
from .mixing import OP1_SQL, op1_mixing
from .packing import op4_packing
from .pii import op8_pii
from .pitman_yor import op11_pitman_yor
from .quality import OP6_SQL, op6_quality
from .simhash import op3_simhash
from .token_counts import op2_token_counts
from .topk import OP9_SQL, op9_topk
from .warc import OP7_SQL, op7_warc
from .whitening import op12_whitening

QUERIES = {"op1_mixing": op1_mixing, "op2_token_counts": op2_token_counts, "op3_simhash": op3_simhash, "op4_packing": op4_packing, "op5_licenses": op5_licenses, "op6_quality": op6_quality, "op7_warc": op7_warc, "op8_pii": op8_pii, "op9_topk": op9_topk, "op10_language_id": op10_language_id, "op11_pitman_yor": op11_pitman_yor, "op12_whitening": op12_whitening, "op13_divergence": op13_divergence}
SQL = {"op1_mixing": OP1_SQL, "op6_quality": OP6_SQL, "op7_warc": OP7_SQL, "op9_topk": OP9_SQL, "op13_divergence": OP13_SQL}
