"""The registered queries of this package; none of them has a SQL form that DuckDB could run over whole tables."""

from .decontaminate import op2_decontaminate
from .extract import op8_extract
from .lattice import op6_lattice
from .neardup import op1_neardup
from .neighbours import op3_neighbours
from .packing import op4_packing
from .pii import op5_pii
from .secrets import op10_secrets
from .substrings import op7_substrings
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_neardup, op2_decontaminate, op3_neighbours, op4_packing, op5_pii, op6_lattice, op7_substrings, op8_extract, op9_toxicity, op10_secrets)}
ORACLES: dict[str, str] = {}
