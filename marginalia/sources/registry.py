"""Which vaults there are and which is the default: two small JSON files, read on the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import REGISTRY


class ConfigError(RuntimeError):
    pass


READ, PARSE = "cannot find vault config; set a default vault or name one", "could not parse vault config; set a default vault or name one"
REGISTRY_READ, REGISTRY_PARSE, NOT_FOUND = "failed to read the vault registry", "failed to parse the vault registry", "vault not found in the vault registry"


def config_home() -> str:
    home = os.environ.get("XDG_CONFIG_HOME") or (os.path.join(os.environ["HOME"], ".config") if os.environ.get("HOME") else None)
    if not home:
        raise ConfigError("user config directory not found")
    return home


def preference_file(home: str | None = None) -> str:
    return os.path.join(home or config_home(), "marginalia", "preferences.json")


def registry_file(home: str | None = None) -> str:
    return os.path.join(home or config_home(), "marginalia", "vaults.json")


def default_name(explicit: str = "", file: str | None = None) -> str:
    """The name given, or the saved one."""
    if explicit:
        return explicit
    try:
        with open(file or preference_file(), encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ConfigError(READ) from e
    try:
        name = json.loads(text)["default_vault_name"]
    except (ValueError, KeyError, TypeError) as e:
        raise ConfigError(PARSE) from e
    if not isinstance(name, str) or not name:
        raise ConfigError(PARSE)
    return name


def set_default_name(name: str, file: str | None = None) -> None:
    file = file or preference_file()
    text = json.dumps({"default_vault_name": name}, separators=(",", ":"), ensure_ascii=False)
    try:
        os.makedirs(os.path.dirname(file), exist_ok=True)
    except OSError as e:
        raise ConfigError("failed to create vault config directory") from e
    try:
        with open(file, "w", encoding="utf-8") as f:
            f.write(text)
        os.chmod(file, 0o644)
    except OSError as e:
        raise ConfigError("failed to write vault config file") from e


def vault_path(name: str, file: str | None = None) -> str:
    """The registered path that ends with the name; of several the smallest."""
    try:
        with open(file or registry_file(), encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ConfigError(REGISTRY_READ) from e
    try:
        vaults = json.loads(text).get("vaults") or {}
        paths = [v.get("path", "") for v in vaults.values()]
    except (ValueError, AttributeError) as e:
        raise ConfigError(REGISTRY_PARSE) from e
    found = sorted(p for p in paths if p.endswith(name)) if name else []
    if not found:
        raise ConfigError(NOT_FOUND)
    return found[0]


def registry(spark: SparkSession, text: str) -> DataFrame:
    """The registry's entries as rows (id, path)."""
    one = spark.range(1).select(F.from_json(F.lit(text), REGISTRY).alias("r"))
    return one.select(F.explode("r.vaults").alias("id", "v")).select("id", F.col("v.path").alias("path"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The entries (id, path) of all registry files in a folder, or of one file, by a scan."""
    files = spark.read.schema(REGISTRY).json(path, multiLine=True)
    return files.select(F.explode("vaults").alias("id", "v")).select("id", F.col("v.path").alias("path"))


def find_vault(registered: DataFrame, name: str) -> DataFrame:
    return registered.where(F.col("path").endswith(name) & F.lit(bool(name))).agg(F.min("path").alias("path")).where("path is not null")
