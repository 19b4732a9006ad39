"""Ports at which other code plugs in, and the loader of plugin folders."""

from __future__ import annotations

import importlib.util
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

API_VERSION = "1"
#: Contracts, all over DataFrames:
#: reader(docs) -> elements; segmenter(docs) -> segments; extractor(segments) -> candidates; candidate_builder(candidates) -> objects;
#: candidate_validator(candidates) -> candidates with ``failed``; graph_storage.save/load; graph_query_engine(query, nodes, edges) -> ids;
#: graph_traversal(request, nodes, edges) -> visits; graph_index(nodes, edges) -> layout; *_type_provider() -> rows; knowledge_validator_provider() -> [objects -> diagnostics].
PORTS = (
    "reader segmenter extractor candidate_builder candidate_validator graph_storage graph_query_engine graph_traversal graph_index "
    "knowledge_type_provider relationship_type_provider evidence_type_provider knowledge_validator_provider"
).split()


@dataclass
class Manifest:
    name: str
    version: str = "0.0.0"
    plugin_api_version: str = API_VERSION
    description: str = ""
    entry_point: str = ""
    ports: list = field(default_factory=list)
    permissions: list = field(default_factory=list)


def read_manifest(folder: Path) -> Manifest:
    """From plugin.yaml or plugin.yml; unknown keys are ignored, a missing name raises."""
    import yaml

    for name in ("plugin.yaml", "plugin.yml"):
        if (folder / name).exists():
            data = yaml.safe_load((folder / name).read_text("utf-8")) or {}
            if not isinstance(data, dict) or not data.get("name"):
                raise ValueError(f"{folder / name}: a manifest needs a name")
            return Manifest(**{k: v for k, v in data.items() if k in Manifest.__dataclass_fields__})
    raise FileNotFoundError(f"{folder} has no plugin.yaml")


class Registry:
    """Implementations by port, in the order of registration."""

    def __init__(self) -> None:
        self._ports: dict[str, list] = defaultdict(list)
        self.plugins: list[Manifest] = []
        self.errors: list[tuple[str, str]] = []

    def register(self, port: str, implementation: Callable | type) -> None:
        if not callable(implementation) and not hasattr(implementation, "port_name"):
            raise TypeError(f"{implementation!r} is neither callable nor has a port_name")
        self._ports[port].append(implementation)

    def resolve(self, port: str) -> list:
        return list(self._ports[port])

    def first(self, port: str, default=None):
        """What wins where plugins come before the engine's own."""
        return self._ports[port][0] if self._ports[port] else default

    def last(self, port: str, default=None):
        """What wins where later registrations replace earlier ones."""
        return self._ports[port][-1] if self._ports[port] else default

    def load(self, folder: str | Path) -> bool:
        """Load one plugin; a failure is recorded in ``errors`` and changes nothing else."""
        folder = Path(folder).expanduser()
        try:
            manifest = read_manifest(folder)
            if str(manifest.plugin_api_version) != API_VERSION:
                raise ValueError(f"plugin api {manifest.plugin_api_version} is not {API_VERSION}")
            module_name, _, function = manifest.entry_point.partition(":")
            path = folder / (module_name.replace(".", "/") + ".py")
            spec = importlib.util.spec_from_file_location(f"lodestone_plugin_{manifest.name}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            getattr(module, function or "register")(self)
        except Exception as e:  # a plugin is foreign code: whatever it raises is reported
            self.errors.append((str(folder), f"{type(e).__name__}: {e}"))
            return False
        self.plugins.append(manifest)
        return True

    def load_all(self, folders: list[str]) -> None:
        """Each folder is a plugin, or holds plugins, which load in the order of their names."""
        for raw in folders:
            folder = Path(raw).expanduser()
            if (folder / "plugin.yaml").exists() or (folder / "plugin.yml").exists():
                self.load(folder)
            elif folder.is_dir():
                for sub in sorted(folder.iterdir()):
                    if (sub / "plugin.yaml").exists():
                        self.load(sub)
