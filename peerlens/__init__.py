"""Peer benchmarking with publication privacy rules, as Spark DataFrame jobs."""

from peerlens.roles import Roles

__all__ = ["Roles"]
