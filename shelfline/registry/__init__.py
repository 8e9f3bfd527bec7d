"""Registered queries, grouped by subject."""

from importlib import import_module

_SUBJECTS = ["prices", "catalogs", "titles", "feeds", "searches", "webpages", "streams"]


def all_registries():
    registries = [import_module(f"shelfline.registry.{subject}").registry for subject in _SUBJECTS]
    names = [name for r in registries for name in r.queries]
    assert len(names) == len(set(names)), "query names must be unique"
    return registries
