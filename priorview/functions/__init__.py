from .columns import *  # noqa: F401,F403
from .frames import *  # noqa: F401,F403
