"""Small written molecules, and a one-at-a-time reading of them to test against."""

import re

SEQUENCES = [
    (1, "CC(=O)Oc1ccccc1C(=O)O"),
    (2, "CC(C)(C)C"),
    (3, "C1CC1.C%12CC%12CC(F)(Cl)Br"),
    (4, "c1ccc2ccccc2c1"),
    (5, "C1CCC1C1CCC1"),
    (6, "C(C(C)C)C"),
]
BOND_COUNTS = {1: 13, 2: 4, 3: 11, 4: 11, 5: 9, 6: 4}

TOKEN = re.compile(r"\[[^\]]+\]|Br|Cl|[BCNOSPFIbcnops]|\(|\)|\.|[-=#:~/\\$]|%[0-9]{2}|[0-9]|.")


def read_molecule(smi):
    """(symbols, set of bonds) by a stack."""
    symbols, bonds, stack, rings, last = [], set(), [], {}, None
    for tok in TOKEN.findall(smi):
        if tok == "(":
            stack.append(last)
        elif tok == ")":
            last = stack.pop()
        elif tok == ".":
            last = None
        elif tok[0] in "-=#:~/\\$":
            continue
        elif tok[0] == "%" or tok.isdigit():
            label = int(tok.strip("%"))
            if label in rings:
                a = rings.pop(label)
                bonds.add((min(a, last), max(a, last)))
            else:
                rings[label] = last
        else:
            symbols.append(tok)
            atom = len(symbols) - 1
            if last is not None:
                bonds.add((last, atom))
            last = atom
    return symbols, bonds
