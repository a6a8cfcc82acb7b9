"""Word lists used when reading prompts back."""

from __future__ import annotations

# Words too common to be a theme.
STOP_WORDS = tuple("""
the and for with that this from have has are was were you your our can not but all any use using
used get got set into out its it is a an to of in on at by be as or if do does did so we i me my
what why how when where which who should would could make made need want please help also just
like than then them they there here one two more new now see let add file files code line lines
error issue problem work working create update change check look looking trying try still back
after before again same other some only very much many most been being will may
""".split())

# How text the person did not type begins. "_" stands for any one character and
# ASCII letters match in either case.
MACHINE_PREFIXES = (
    "<task-notification",
    "<system-reminder",
    "<ide_",
    "<command-",
    "<local-command",
    "[Request interrupted",
    "Caveat: The messages below were generated",
    "This session is being continued from a previous",
)
