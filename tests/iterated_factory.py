"""A factory for the test of the iterated source; workers import it by its path."""


def numbers(number, parts):
    for _ in range(2):
        yield number, parts
