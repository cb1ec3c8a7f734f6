"""Registered queries; importing the package files them all."""

from speechframe.plans import conversation, voices  # noqa: F401
