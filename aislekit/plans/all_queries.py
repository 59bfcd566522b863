"""Import every query module so that its queries register."""

from . import q_rules  # noqa: F401
from . import q_placement  # noqa: F401
from . import q_text  # noqa: F401
from . import q_model  # noqa: F401
from . import q_flows  # noqa: F401
