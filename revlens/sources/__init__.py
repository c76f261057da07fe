from revlens.sources.files import *  # noqa: F401,F403
from revlens.sources.testdata import *  # noqa: F401,F403
from revlens.sources.dimensions import *  # noqa: F401,F403
