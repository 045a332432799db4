"""Driver-side rules on column names and types. They see schemas only, never data."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Vocabularies of the naming convention of the source portals.
DATE_PREFIXES = ("din", "dat", "dt", "data", "dia", "mes", "ano_mes", "periodo", "hora")
DATE_SUFFIXES = ("_data", "_dia", "_inicio", "_fim", "_referencia", "_instante")
DATE_STARTS = ("dat", "data")
CODE_PREFIXES = ("id", "cod", "ceg", "ide", "sig", "nom", "dsc", "num_cnpj", "num_cpf", "cnpj", "cpf", "cep",
                 "codigo", "sgl", "tip")
CODE_SUFFIXES = ("cnpj", "cpf", "_cep", "codigo", "_ceg", "_id", "_cod")
TIME_COLUMNS = ("din_instante", "din_programacaodia", "dat_programacao")
DAY_COLUMNS = ("din_programacaodia", "dat_programacao")
PACKED_DAY_COLUMN = "dat_programacao"
INTEGER_COLUMNS = ("num_patamar", "tip_terminal", "id_conjuntousina")
NOT_TIME = ("geracaoconjunto", "processamento", "atualiza", "carga_dados", "dataversao", "versao")

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = INTEGERS + (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def normal_name(name: str) -> str:
    """Lower-case ASCII words joined by underscores; ``coluna`` when nothing is left."""
    ascii_only = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    words = re.findall(r"[a-z0-9]+", ascii_only.lower())
    return "_".join(words) if words else "coluna"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename all columns; two columns that fall together are an error, not a silent loss."""
    names = [normal_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns fall together after renaming: {clash}")
    return df.toDF(*names)


def _starts_as_word(name: str, words: Iterable[str]) -> bool:
    return any(name == w or name.startswith(f"{w}_") for w in words)


def looks_like_date(name: str) -> bool:
    return _starts_as_word(name, DATE_PREFIXES) or name.endswith(DATE_SUFFIXES) or name.startswith(DATE_STARTS)


def is_code(name: str) -> bool:
    """Identifiers stay text, which keeps their leading zeros."""
    return _starts_as_word(name, CODE_PREFIXES) or name.endswith(CODE_SUFFIXES)


def convention_type(name: str) -> T.DataType:
    """Type that the naming convention gives to a column."""
    if name in DAY_COLUMNS:
        return T.DateType()
    if name in TIME_COLUMNS:
        return T.TimestampNTZType()
    if name.startswith("num_minutos"):
        return T.LongType()
    if name.startswith("val_"):
        return T.DoubleType()
    if name.startswith("flg_") or name in INTEGER_COLUMNS:
        return T.IntegerType()
    return T.StringType()


def fixed_time_column(columns: Iterable[str]) -> str | None:
    have = set(columns)
    return next((c for c in TIME_COLUMNS if c in have), None)


def may_be_time(name: str) -> bool:
    """Dates of file generation or processing do not describe the period of the data."""
    return name != "ano" and not any(word in name for word in NOT_TIME)


def settled_type(types: Iterable[T.DataType]) -> T.DataType | None:
    """Type that follows from the per-file types alone, or None when the content must decide."""
    kinds = list({t.simpleString(): t for t in types}.values())
    if len(kinds) == 1 and isinstance(kinds[0], NUMBERS + TIMES + (T.BooleanType,)):
        return kinds[0]
    if all(isinstance(t, NUMBERS) for t in kinds):
        return T.LongType() if all(isinstance(t, INTEGERS) for t in kinds) else T.DoubleType()
    return None


def reconciled_type(name: str, types: Iterable[T.DataType], filled: int, bad_times: int, bad_numbers: int) -> T.DataType:
    """Type of a column over all its files, given the probe counts over its whole content.

    A column without any value stays text: nothing speaks for a number.
    """
    types = list(types)
    settled = settled_type(types)
    if settled is not None:
        return settled
    temporal = any(isinstance(t, TIMES) for t in types)
    if (temporal or looks_like_date(name)) and bad_times == 0 and (filled or temporal):
        return T.TimestampNTZType()
    if is_code(name) or not filled:
        return T.StringType()
    return T.DoubleType() if bad_numbers == 0 else T.StringType()


def signature(df: DataFrame) -> tuple[tuple[str, str], ...]:
    """Lower-cased names with types, in order: files with equal signatures can be read together."""
    return tuple((f.name.lower(), f.dataType.simpleString()) for f in df.schema.fields)
