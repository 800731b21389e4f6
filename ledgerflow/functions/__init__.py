"""Part of ledgerflow; see the README."""
