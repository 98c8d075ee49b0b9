"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import clustering, decontamination, jaccard, licenses, linededup, negatives, secrets, urlfilter, warc
from .clustering import op13_clustering
from .decontamination import op9_decontamination
from .jaccard import op3_jaccard
from .language import op2_language
from .licenses import op1_licenses
from .linededup import op8_linededup
from .media import op10_media
from .negatives import op11_hardnegatives
from .packing import op5_packing
from .secrets import op6_secrets
from .sharding import op4_sharding
from .urlfilter import op12_urlfilter
from .warc import op7_warc

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_language": op2_language,
    "op3_jaccard": op3_jaccard,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_linededup": op8_linededup,
    "op9_decontamination": op9_decontamination,
    "op10_media": op10_media,
    "op11_hardnegatives": op11_hardnegatives,
    "op12_urlfilter": op12_urlfilter,
    "op13_clustering": op13_clustering,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op3_jaccard": jaccard.ORACLE,
    "op6_secrets": secrets.oracle(),
    "op7_warc": warc.ORACLE,
    "op8_linededup": linededup.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op11_hardnegatives": negatives.ORACLE,
    "op12_urlfilter": urlfilter.oracle(),
    "op13_clustering": clustering.oracle(),
}
