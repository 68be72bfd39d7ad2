"""Queries over the input tables, in books by subject."""

from __future__ import annotations

from importlib import import_module

from textloom.plans.book import Book

BOOKS = ("stats", "corpus", "retrieve", "judge", "kernels", "meta", "streams", "prompts", "flows", "rest", "kept", "answers")


def all_books() -> list[Book]:
    return [import_module(f"textloom.plans.{name}").book for name in BOOKS]
