"""Versions of schemas by namespace: upload merges, replace drops what is gone."""

from __future__ import annotations

from dataclasses import dataclass, field

from mnemospark.plans.dsl import DslError, Schema, parse, validate


@dataclass
class SchemaStore:
    versions: dict[str, list[Schema]] = field(default_factory=dict)

    def get(self, namespace: str, version: int | None = None) -> Schema:
        return self.versions[namespace][(version or len(self.versions[namespace])) - 1]

    def list(self) -> list[tuple[str, int]]:
        return [(n, len(v)) for n, v in sorted(self.versions.items())]

    def upload(self, text: str, replace: bool = False) -> tuple[int, dict[str, str]]:
        """(version, changes): what was added, changed or removed."""
        new = parse(text)
        if wrong := validate(new):
            raise DslError("; ".join(wrong))
        old = self.versions.get(new.namespace, [Schema(new.namespace)])[-1]
        changes = {}
        for what, declared in new.declared.items():
            for name, body in declared.items():
                if old.declared[what].get(name) != body:
                    changes[f"{what} {name}"] = "changed" if name in old.declared[what] else "added"
            for name, body in old.declared[what].items():
                if name not in declared:
                    if replace:
                        changes[f"{what} {name}"] = "removed"
                    else:
                        declared[name] = body
        self.versions.setdefault(new.namespace, []).append(new)
        return len(self.versions[new.namespace]), changes
