"""Message catalogs: a parser for DBC text, and its tables.

Read are messages (BO_), signals (SG_ with multiplexing M, mN and mNM, and ranges by SG_MUL_VAL_), value tables
(VAL_) and value types (SIG_VALTYPE_); other sections are skipped. Catalogs are small and parsed on the driver.
"""

from __future__ import annotations

import re
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from canloom.functions.tables import local
from canloom.model import EFF_BIT, ID_MASK, MESSAGES, SIGNALS, Catalog, MessageDef, SignalDef

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_MESSAGE = re.compile(r"BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+(\w+)\s*$")
_SIGNAL = re.compile(
    rf'SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(\s*({_NUMBER})\s*,\s*({_NUMBER})\s*\)\s*\[\s*{_NUMBER}\s*\|\s*{_NUMBER}\s*\]\s*"([^"]*)"\s*(.*)$'
)
_VALUES = re.compile(r"VAL_\s+(\d+)\s+(\w+)\s+(.*);\s*$", re.S)
_PAIR = re.compile(r'([-+]?\d+)\s+"([^"]*)"')
_VALTYPE = re.compile(r"SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:\s*([0-3])\s*;")
_RANGES = re.compile(r"SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+(.*);\s*$", re.S)
#: Sections that are skipped.
_SECTIONS = set(
    "VERSION NS_ NS_DESC_ BS_ BU_ CM_ BA_DEF_ BA_ VAL_ CAT_DEF_ CAT_ FILTER BA_DEF_DEF_ EV_DATA_ ENVVAR_DATA_ SGTYPE_ SGTYPE_VAL_ BA_DEF_SGTYPE_ BA_SGTYPE_ SIG_TYPE_REF_ VAL_TABLE_ SIG_GROUP_ SIG_VALTYPE_ SIGTYPE_VALTYPE_ "
    "BO_TX_BU_ BA_DEF_REL_ BA_REL_ BA_DEF_DEF_REL_ BA_SGTYPE_REL_ BU_SG_REL_ BU_EV_REL_ BU_BO_REL_ SG_MUL_VAL_ EV_".split()
)
#: A message that stands for signals of no message.
_UNASSIGNED = "VECTOR__INDEPENDENT_SIG_MSG"
_NOBODY = "Vector__XXX"


def decode_text(raw: bytes) -> str:
    """UTF-8 if it is, else GBK; NULs at the end are padding."""
    raw = raw.rstrip(b"\x00")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gbk")


def _key(frame_id: int) -> int:
    return (frame_id & ID_MASK) | EFF_BIT if frame_id & EFF_BIT else frame_id


def _signal(m: re.Match, ordinal: int) -> SignalDef:
    name, mux, start, length, order, sign, scale, offset, unit = m.groups()[:9]
    ids = (int(mux.strip("mM")),) if mux and mux[0] == "m" else None
    if not int(length):
        raise ValueError(f"signal {name} has no bits")
    return SignalDef(
        name=name,
        start_bit=int(start),
        length=int(length),
        scale=float(scale) or 1.0,
        offset=float(offset),
        unit=unit,
        is_signed=sign == "-",
        byte_order="little" if order == "1" else "big",
        is_multiplexer=bool(mux) and mux[-1] == "M",
        multiplexer_ids=ids,
        file_ordinal=ordinal,
    )


def _statements(text: str) -> list[str]:
    """Lines, those of an open VAL_ or SG_MUL_VAL_ or of an open string joined."""
    out: list[str] = []
    for line in text.splitlines():
        line = line.rstrip()
        opened = out and (out[-1].count('"') % 2 or re.match(r"\s*(VAL_|SG_MUL_VAL_)\s", out[-1]) and not out[-1].endswith(";"))
        if opened:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return [s.strip() for s in out]


def parse(text: str, path: str = "") -> Catalog:
    """The catalog in a DBC text; a malformed message, signal or value line is an error that names the path."""
    found: dict[int, tuple[str, int, str, list[SignalDef]]] = {}
    here: list[SignalDef] | None = None
    changes: list[tuple[int, str, dict]] = []
    try:
        for s in _statements(text):
            if s.startswith("BO_ "):
                if not (m := _MESSAGE.match(s)):
                    raise ValueError(f"message line: {s[:80]}")
                here = []
                if m[2] != _UNASSIGNED:
                    found[_key(int(m[1]))] = (m[2], int(m[3]), "Unknown" if m[4] == _NOBODY else m[4], here)
            elif s.startswith("SG_ "):
                if here is None or not (m := _SIGNAL.match(s)):
                    raise ValueError(f"signal line: {s[:80]}")
                here.append(_signal(m, len(here)))
            elif m := _VALUES.match(s):
                changes.append((_key(int(m[1])), m[2], {"choices": {int(a): b for a, b in _PAIR.findall(m[3])}}))
            elif m := _VALTYPE.match(s):
                changes.append((_key(int(m[1])), m[2], {"is_float": m[3] in "12"}))
            elif m := _RANGES.match(s):
                ids = [k for a, b in re.findall(r"(\d+)\s*-\s*(\d+)", m[4]) for k in range(int(a), int(b) + 1)]
                changes.append((_key(int(m[1])), m[2], {"multiplexer_ids": tuple(sorted(ids))}))
            elif re.match(r"(VAL_|SIG_VALTYPE_|SG_MUL_VAL_)\s+\d", s):
                raise ValueError(f"line: {s[:80]}")
            elif s and not s.startswith("//") and s.split()[0].rstrip(":") not in _SECTIONS:
                raise ValueError(f"line: {s[:80]}")
        for key, name, change in changes:
            signals = found[key][3] if key in found else []
            for i, s in enumerate(signals):
                if s.name == name:
                    signals[i] = replace(s, **change)
    except (ValueError, KeyError, IndexError) as e:
        raise ValueError(f"failed to parse DBC '{path}': {e}") from e
    messages = {k: MessageDef(name, k, node, size, tuple(sorted(signals, key=lambda s: (s.position, s.file_ordinal)))) for k, (name, size, node, signals) in found.items()}
    return Catalog(path, messages)


def load(path: str) -> Catalog:
    try:
        text = decode_text(Path(path).read_bytes())
    except UnicodeDecodeError as e:
        raise ValueError(f"failed to parse DBC '{path}': {e}") from e
    return parse(text, path)


def messages_table(spark: SparkSession, catalogs: list[Catalog]) -> DataFrame:
    rows = [(c.path, m.arb_norm, m.name, m.node, m.is_extended, m.frame_length) for c in catalogs for m in c.messages.values()]
    return local(spark, rows, MESSAGES)


def signals_table(spark: SparkSession, catalogs: list[Catalog]) -> DataFrame:
    rows = [
        (c.path, m.arb_norm, i, s.file_ordinal, s.name, s.start_bit, s.length, s.byte_order, s.is_signed, s.is_float, s.scale, s.offset, s.unit, s.is_multiplexer, list(s.multiplexer_ids) if s.multiplexer_ids is not None else None, s.choices)
        for c in catalogs
        for m in c.messages.values()
        for i, s in enumerate(m.signals)
    ]
    return local(spark, rows, SIGNALS)
