"""The engine's queries over the standard tables, by area; importing a module registers its queries."""

from . import custom, flows, relational, scalars, stores  # noqa: F401
