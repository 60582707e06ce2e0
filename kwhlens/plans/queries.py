"""Import every query module so that the registry is complete."""

from kwhlens.plans import registry  # noqa: F401
from kwhlens.plans import q_matching  # noqa: F401
from kwhlens.plans import q_effects  # noqa: F401
from kwhlens.plans import q_datasets  # noqa: F401
from kwhlens.plans import q_sources  # noqa: F401
