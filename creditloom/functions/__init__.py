"""Column functions. All but the Unicode decomposition are JVM expressions."""

from .ids import *  # noqa: F401,F403
from .numbers import *  # noqa: F401,F403
from .text import *  # noqa: F401,F403
from .times import *  # noqa: F401,F403
from .variants import *  # noqa: F401,F403
