"""Registered queries: each reads the driver's tables; most carry an independent SQL twin."""
