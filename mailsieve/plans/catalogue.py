"""All registered queries; importing this module fills the registry."""

from . import body_queries, identity_queries, lookup_queries, message_queries, result_queries, stream_queries  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401
