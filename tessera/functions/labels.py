"""Coercions of cells, and the words that states are shown by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.texts import header_key, title_key

#: Labels of relations, costs and refunds.
STRENGTH = {"forte": "Forte", "medio": "Média", "fraco": "Fraca"}
NO_RELATION = "Sem relação confirmada"
REFUND = {"revertido": "Desconsiderado / revertido", "sinalizado_pendente": "Aprovado · a receber", "recebido_confirmado": "Recebido confirmado"}
UNKNOWN_STATE = "Situação não informada"
YES, NO = ("sim", "true", "1", "elegivel"), ("nao", "false", "0", "nao elegivel")


def relation(strength: Column, audited: Column) -> Column:
    out = F.lit(NO_RELATION)
    for key, label in STRENGTH.items():
        out = F.when(audited & (header_key(strength) == key), label).otherwise(out)
    return out


def availability(status: Column) -> Column:
    return F.when(status.rlike(r"(?i)(?:confirm|^ok$|dispon)"), "Disponível").otherwise("Pendente")


def refund(status: Column, received: Column) -> Column:
    """A refund's state; the day follows where it is known."""
    out = F.lit(UNKNOWN_STATE)
    for key, label in REFUND.items():
        out = F.when(status == key, label).otherwise(out)
    return F.concat_ws(" · ", out, F.date_format(received, "dd/MM/yyyy"))


def cost(kind: Column, status: Column, day: Column) -> Column:
    shown = F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit("Data do pagamento não informada"))
    done = F.concat_ws(" · ", F.when(kind == "Pagamento", "Saída de custo confirmada").otherwise("Custo realizado confirmado"), shown)
    return F.when(status.isNull() | (status == "nao_informado"), UNKNOWN_STATE).when(status == "revertido", REFUND["revertido"]).otherwise(done)


def number(text: Column) -> Column:
    """A plain number's text, else null."""
    return F.when(F.trim(text).rlike(r"^-?\d+(?:\.\d+)?$"), F.trim(text))


def whole(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"^-?\d+(?:\.0+)?$"), F.regexp_replace(F.trim(text), r"\.0+$", ""))


def grouped_number(text: Column) -> Column:
    """A number with a decimal comma and group points, or plain; zeros at both ends go."""
    bare = F.trim(text)
    plain = F.when(F.contains(bare, F.lit(",")), F.regexp_replace(F.replace(bare, F.lit("."), F.lit("")), ",", ".")).otherwise(bare)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.rlike(r"^-?\d+(?:\.\d+)?$"), short)


def yes_no(text: Column) -> Column:
    key = title_key(text)
    return F.when(key.isin(*YES) | F.startswith(key, F.lit("sim ")), True).when(key.isin(*NO) | F.startswith(key, F.lit("nao ")), False)


def tri_state(text: Column) -> Column:
    """``yes``, ``no`` or ``unknown`` (null); anything else raises an error."""
    return F.when(text == "yes", True).when(text == "no", False).when(text == "unknown", None).otherwise(F.raise_error(F.concat(F.lit("not a state: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def header_id(sha256: Column, ordinal: Column, label: Column) -> Column:
    """A header's identifier from its source, place and normalised label, parted by zero bytes."""
    zero = F.lit(b"\x00")
    binary = lambda c: c.cast("string").cast("binary")
    return F.sha2(F.concat(binary(sha256), zero, F.lit(b"header"), zero, binary(ordinal), zero, binary(header_key(label))), 256)


def bar_width(value: Column, most: Column) -> Column:
    """Per cent of the longest bar; a value other than zero shows at least one."""
    return F.when(value == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), F.abs(value) * 100.0 / F.greatest(F.lit(1), most)))
