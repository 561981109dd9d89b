"""Tables that are read, with fixed schemas."""

from __future__ import annotations

CASES = (
    "tenant bigint, degree bigint, case_no bigint, queue string, sector string, unit string, class string, subject string, priority boolean, "
    "sealed boolean, arrival date, last_mov date, tags array<string>"
)
#: The whole key of a case: numbers are only unique inside of a court and degree.
CASE_KEY = ["tenant", "degree", "case_no"]
PIECE_KEY = [*CASE_KEY, "piece_id"]
TURN_KEY = [*CASE_KEY, "turn"]
CASE_LIST = "case_no string, rejected string"
ANALYSIS = (
    "situation string, next_act string, suggestions array<struct<kind: string, name: string>>, "
    "deadlines array<struct<what: string, due: string>>, alerts array<string>, summary string, parties array<string>, answer string"
)
NOTE = "tenant bigint, degree bigint, case_no bigint, piece_id bigint, note_id bigint, text string, sender_code string, sender_name string, created_ts string"
ENTITY = "tenant bigint, degree bigint, case_no bigint, piece_id bigint, kind string, value string, start bigint, `end` bigint"

# fixed values: the fields that may leave for each destination
PRESETS = {
    "triage": ("degree", "case_no", "class", "subject", "queue", "tags", "priority", "sealed", "unit", "arrival", "last_mov"),
    "panel": ("tenant", "degree", "case_no", "class", "subject", "queue", "tags", "priority", "sealed", "unit", "arrival", "last_mov"),
    "agent_list": ("degree", "case_no", "class", "queue", "tags", "arrival", "last_mov"),
    "hearing": ("tenant", "degree", "case_no", "hearing_date", "hour", "type", "name", "qualification"),
    "party_register": ("tenant", "degree", "case_no", "name", "role", "status"),
}
#: The fields of the action log; nothing else is logged.
LOGGED = ("action_id", *CASE_KEY, "tag", "exit", "outcome", "included", "run_id", "ts", "profile")
DENIED = frozenset(("cpf", "cnpj", "rg", "document", "documents", "oab"))
