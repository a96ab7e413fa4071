"""What can go wrong, with the exit code that a command line would give."""


class FirmlakeError(Exception):
    exit_code = 1


class UnsupportedTarget(FirmlakeError):
    exit_code = 3


class ParseError(FirmlakeError):
    exit_code = 4


class ToolError(FirmlakeError):
    exit_code = 5


class CorpusMissing(FirmlakeError):
    exit_code = 6


class UsageError(FirmlakeError):
    exit_code = 7
