"""Queries of this package by name, and their SQL where there is any."""

from __future__ import annotations

from .q_chat import op9_chat
from .q_crosspolytope import OP3_SQL, op3_crosspolytope
from .q_decontaminate import OP5_SQL, op5_decontaminate
from .q_htmltext import op7_htmltext
from .q_langid import op6_langid
from .q_lm import op4_lm
from .q_mixing import op2_mixing
from .q_secrets import op10_secrets
from .q_simhash import op8_simhash
from .q_warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_crosspolytope": op3_crosspolytope,
    "op4_lm": op4_lm,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_htmltext": op7_htmltext,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
}
SQL = {"op1_warc": OP1_SQL, "op3_crosspolytope": OP3_SQL, "op5_decontaminate": OP5_SQL}
