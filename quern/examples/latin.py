def f():
    return "caf�"
