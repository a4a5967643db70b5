"""Small sources written for the tests, and what an audit finds in them."""

# Two contracts: a guarded registry, and a relay that inherits from it.
CONTRACT = """// Reports go through the relay.
pragma solidity ^0.8.20;

abstract contract Registry {
    mapping(address => bool) internal keepers;
    modifier onlyRole(bytes32 role) { _; }

    function addKeeper(address who) public onlyRole("KEEPER") {
        keepers[who] = true;
    }

    function isKeeper(address who) public view returns (bool) {
        return keepers[who];
    }
}

contract Relay is Registry {
    uint64 private last;

    function submitReport(uint64 slot, bytes calldata body) external {
        require(slot > last, "old");
        last = slot; // then applyReport
    }

    function updateReserve(uint64 floor) public { last = floor; }

    function forward(address to, bytes memory body) public payable {
        (bool ok, ) = to.call {value: msg.value}(body);
        if (!ok) { to.delegatecall(body); }
    }

    function removeKeeper(address who) external {
        delete keepers[who];
    }

    function signed(address a, uint256 n) external pure returns (bytes32) {
        return keccak256(abi.encode("EIP712 permit(address,uint256)", a, n));
    }
}
"""
FIRST_PATTERN_HITS = {("EVM-2001", 29), ("EVM-2002", 28), ("EVM-4001", 37), ("EVM-5002", 22)}
ALL_PATTERN_HITS = FIRST_PATTERN_HITS | {("EVM-5002", 20)}
OPEN_SETTER_LINES = {25, 32}

# (contract, name, visibility, mutability, modifiers) of the functions, as a compiler lists them.
CONTRACT_FUNCTIONS = [
    ("Registry", "addKeeper", "public", "nonpayable", ["onlyRole"]),
    ("Registry", "isKeeper", "public", "view", []),
    ("Relay", "submitReport", "external", "nonpayable", []),
    ("Relay", "updateReserve", "public", "nonpayable", []),
    ("Relay", "forward", "public", "payable", []),
    ("Relay", "removeKeeper", "external", "nonpayable", []),
    ("Relay", "signed", "external", "pure", []),
]


def contract_tree() -> dict:
    contracts: dict[str, list[dict]] = {"Registry": [], "Relay": []}
    for contract, name, visibility, mutability, modifiers in CONTRACT_FUNCTIONS:
        start = CONTRACT.index(f"function {name}")
        line_end = CONTRACT.index("\n", start)
        one_line = CONTRACT[start:line_end].endswith("}")
        end = line_end if one_line else CONTRACT.index("\n    }\n", start) + len("\n    }")
        contracts[contract].append({
            "nodeType": "FunctionDefinition",
            "name": name,
            "visibility": visibility,
            "stateMutability": mutability,
            "src": f"{start}:{end - start}:0",
            "modifiers": [{"modifierName": {"name": m}} for m in modifiers],
        })
    variable = {"nodeType": "VariableDeclaration", "name": "last", "src": "0:1:0"}
    return {
        "nodeType": "SourceUnit",
        "nodes": [
            {"nodeType": "PragmaDirective", "literals": ["solidity"]},
            *({"nodeType": "ContractDefinition", "name": n, "nodes": [variable, *f]} for n, f in contracts.items()),
        ],
    }


# Nodes (kind, name, path_len, op) of four programs in the order a parser visits them: a
# program with a qualified call only, an exchange with arithmetic and an endless loop, a
# pool and a plain one.
FN = ("fn", "f", None, None)
STRUCT = ("struct", "S", None, None)
QUALIFIED = ("call", "invoke", 4, None)
PROGRAM_NODES = {
    "anchor": [FN, FN, ("binary", None, None, "-="), FN, QUALIFIED, STRUCT, STRUCT],
    "exchange": [
        FN, ("binary", None, None, "*"), ("binary", None, None, "/"), FN, ("loop", None, None, None),
        FN, ("call", "try_from_slice", 2, None), STRUCT,
    ],
    "pool": [FN, FN, QUALIFIED, STRUCT],
    "plain": [FN, STRUCT],
    "plain too": [FN, STRUCT],
}
COLLAPSED = {
    "anchor": {("S-2035", "low"), ("S-2002", "medium")},
    "exchange": {("S-2035", "low"), ("S-1003", "critical"), ("S-2036", "high"), ("S-2002", "medium")},
    "pool": {("S-2035", "low"), ("S-2002", "medium")},
    "plain": {("S-2035", "low"), ("S-2002", "medium")},
    "plain too": {("S-2035", "low"), ("S-2002", "medium")},
}

# The same programs as texts: an anchored one with a qualified call and an assignment that is
# no sum, an exchange, a pool and two plain ones.
PROGRAM_TEXTS = {
    "anchor": """
#[program]
pub mod vault { // fn not_this(a + b)
    pub fn open(ctx: Context<Open>, amount: u64) -> Result<()> {
        let vault = &mut ctx.accounts.vault;
        vault.total -= amount;
        token::program::cpi::invoke(ctx.accounts.into(), amount)?;
        msg!("left: {}", vault.total - amount);
        Ok(())
    }
}
#[derive(Accounts)]
pub struct Open<'info> {
    #[account(init, payer = user, space = 8 + 32, has_one = user)]
    pub vault: Account<'info, Vault>,
}
""",
    "exchange": """
struct Pair { a: u64, b: u64 }
impl Pair {
    fn method_only(&self) -> u64 { 0 }
}
fn quote(a: u64, b: u64) -> u64 {
    a * b / 2 /* a + b /* fn inner() */ */
}
fn wait(url: &str) {
    loop { let here = "http://x"; break; }
    let state = State::try_from_slice(here);
}
""",
    "pool": """
pub fn enter() {}
trait Pool { fn size(&self) -> u64; fn more(&self) { } }
impl<T: Clone + Copy> Pool for Shares<T> { fn size(&self) -> u64 { 1 } }
fn leave() { solana::program::invoke(r#"fn hidden() { loop {"#, '{', &["+"]); }
struct Shares<T> { each: Vec<T> }
""",
    "plain": "fn run() {}\nstruct Empty;\n",
    "plain too": "/* struct A; fn b() */ fn run() {}\nstruct Empty;\n",
}
