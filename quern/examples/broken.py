def good():
    return 1

def bad(:
  x = (
