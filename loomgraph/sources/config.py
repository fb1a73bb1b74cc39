"""Settings of the engine, with their limits checked."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    max_results: int = 5
    chunk_size: int = 30_000
    chunk_overlap: int = 200
    history_messages: int = 6
    context_messages: int = 10

    def __post_init__(self):
        if self.max_results < 1 or self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("settings out of range")

    @staticmethod
    def of(values: dict) -> Settings:
        """From a parsed file; unknown names are errors."""
        known = {f.name for f in fields(Settings)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return Settings(**values)

    @staticmethod
    def load(path: str) -> Settings:
        """From a file of lines name: number, the plain part of YAML; blank lines and comments don't count. Load it anew to see changes."""
        values = {}
        for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
            line = line.split("#", 1)[0].strip()
            if line:
                name, colon, value = line.partition(":")
                if not colon or not value.strip().isdigit():
                    raise ValueError(f"line {n} of the settings isn't a name and a number")
                values[name.strip()] = int(value)
        return Settings.of(values)


#: Sections and names of a settings file that the engine's own settings come from.
OWN = {("rag", "max_results"): "max_results", ("data_pipeline", "max_chunk_size"): "chunk_size", ("data_pipeline", "chunk_overlap"): "chunk_overlap"}
Section = Mapping[str, object]


@dataclass(frozen=True)
class Configuration:
    """A settings file in sections: the engine's settings, the prompts by name, the models by role, and all other sections as they stand."""

    settings: Settings
    prompts: Mapping[str, str] = field(default_factory=dict)
    models: Mapping[str, Section] = field(default_factory=dict)
    sections: Mapping[str, Section] = field(default_factory=dict)

    @staticmethod
    def of(tree: object) -> Configuration:
        """From a parsed file. Values stay as written: ${NAME} is not looked up in the environment."""
        if not isinstance(tree, dict) or not all(isinstance(s, dict) for s in tree.values()):
            raise ValueError("a settings file holds sections of names and values")
        own = {}
        for (section, name), to in OWN.items():
            value = tree.get(section, {}).get(name)
            if value is not None:
                if type(value) is not int:
                    raise ValueError(f"{section}.{name} isn't a whole number")
                own[to] = value
        prompts, models = tree.get("prompts", {}), tree.get("llm", {})
        if bad := sorted(str(k) for k, v in prompts.items() if not isinstance(v, str)):
            raise ValueError(f"prompts that aren't texts: {bad}")
        if bad := sorted(str(k) for k, v in models.items() if not isinstance(v, dict) or not isinstance(v.get("name"), str)):
            raise ValueError(f"models without a name: {bad}")
        return Configuration(Settings.of(own), prompts, models, {k: v for k, v in tree.items() if k not in ("prompts", "llm")})


class ConfigurationFile:
    """A settings file that is read once; reload() reads it anew, and keeps what was read before if the file has become invalid."""

    def __init__(self, path: str):
        self.path, self._read = Path(path), None

    def get(self) -> Configuration:
        return self._read or self.reload()

    def reload(self) -> Configuration:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("settings in sections need the package yaml") from e
        if not self.path.is_file():
            raise FileNotFoundError(f"no settings file at {self.path}")
        try:
            tree = yaml.safe_load(self.path.read_text(encoding="utf-8"))
        except yaml.YAMLError as e:
            raise ValueError(f"the settings file isn't YAML: {e}") from e
        self._read = Configuration.of(tree)
        return self._read
