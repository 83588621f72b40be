from episurv.functions.codes import *  # noqa: F401,F403
from episurv.functions.columns import *  # noqa: F401,F403
