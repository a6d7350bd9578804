import os


# Adds up.
# Twice over.
def top(a, b=1):
    """Docstring of top."""
    helper(a)
    def nested():
        return os.path.join("x", "check_it()")
    return nested()


@cache
@registry.register("deco")
async def decorated(x):
    return await service.fetch(x)


class Outer(Base):
    '''Class doc.'''

    limit = 3

    class Inner:
        @property
        def deep(self): return self.a.b().c(top(1), items[0].run(2))

    def method(self):
        # check_it() is only named here
        text = "check_it()"
        return check_it(text)


if os.name:
    def conditional():
        r'Raw.'
        return Outer().method()


def tail(): return f"{check_it(1)} {{no()}}" + ", ".join(names)
