"""Checks by source; importing the package registers all of them."""

from . import billing, ledger, payroll, quality, scheduling  # noqa: F401
