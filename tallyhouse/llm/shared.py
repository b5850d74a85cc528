"""Lineage cuts of the engine, by the name that this subpackage knows them by."""

from tallyhouse.functions.lasting import Scratch, lasting, lasting_in_order

__all__ = ["Scratch", "lasting", "lasting_in_order"]
