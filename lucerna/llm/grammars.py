"""Grammars of the languages whose files are checked, as EBNF text for :class:`gll.Grammar`.

'x' is a token, UPPER a token class, @Rule a bracket pair whose inside derives Rule,
ASI the place before a line break or the end of a list, where a semicolon may be missing.
The grammars describe syntax only: names, types and imports are never resolved.
"""

PYTHON = r"""
Exprs = StarExpr (',' StarExpr)* ','? ;
StarExpr = '*' Disj | Expr | NAME ':=' Expr ;
Expr = 'lambda' LParams? ':' Expr | Disj ('if' Disj 'else' Expr)? ;
LParams = LParam (',' LParam)* ','? ;
LParam = '*' | '/' | '*' NAME | '**' NAME | NAME ('=' Expr)? ;
Disj = Un (BinOp Un)* ;
BinOp = BINOP | '*' | '**' | '-' | '+' | '/' | '@' | '|' | '<' | '>' | '==' | 'in' | 'not' 'in' | 'is' 'not'? ;
Un = ('not' | '-' | '+' | '~' | 'await')* Atom Trailer* ;
Atom = NAME | NUM | STR+ | '...' | 'None' | 'True' | 'False' | @Paren | @Items | @Braces ;
Trailer = '.' NAME | @Args | @Index ;
Comp = ('async'? 'for' Targets 'in' Disj ('if' NDisj)*)+ ;
NDisj = NAME ':=' Expr | 'lambda' LParams? ':' Expr | Disj ;
Targets = Target (',' Target)* ','? ;
Target = '*'? (NAME | @Paren | @Items | Atom Trailer+) ;
Paren = (Exprs | StarExpr Comp | 'yield' ('from' Expr | Exprs)?)? ;
Items = (Exprs | StarExpr Comp)? ;
Braces = (Pair (',' Pair)* ','? | Expr ':' Expr Comp | Exprs | StarExpr Comp)? ;
Pair = '**' Disj | Expr ':' Expr ;
Args = (Arg (',' Arg)* ','? | StarExpr Comp)? ;
Arg = '*' Expr | '**' Expr | NAME '=' Expr | NAME ':=' Expr | Expr ;
Index = Sub (',' Sub)* ','? ;
Sub = '*' Disj | NAME ':=' Expr | Expr? ':' Expr? (':' Expr?)? | Expr ;
Params = (Param (',' Param)* ','?)? ;
Param = '/' | '*' | ('*' | '**')? NAME (':' ('*'? Expr))? ('=' Expr)? ;
TParams = TParam (',' TParam)* ','? ;
TParam = ('*' | '**')? NAME (':' Expr)? ('=' StarExpr)? ;
Simple = Small (';' Small)* ';'? ;
Small = Exprs AssignTail? | 'yield' ('from' Expr | Exprs)? | 'del' Targets | 'pass' | 'break' | 'continue'
  | 'return' Exprs? | 'raise' (Expr ('from' Expr)?)? | ('global' | 'nonlocal') NAME (',' NAME)*
  | 'import' DottedAs (',' DottedAs)* | 'from' ('.' | '...')* Dotted 'import' Imported | 'from' ('.' | '...')+ 'import' Imported
  | 'assert' Expr (',' Expr)? | 'type' NAME @TParams? '=' Expr ;
AssignTail = ':' Expr ('=' Value)? | ('=' Value)+ | AUGOP Value ;
Value = 'yield' ('from' Expr | Exprs)? | Exprs ;
Dotted = NAME ('.' NAME)* ;
DottedAs = Dotted ('as' NAME)? ;
Imported = '*' | NAME ('as' NAME)? (',' NAME ('as' NAME)?)* | @Names ;
Names = NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ','? ;
Named = NAME ':=' Expr | Expr ;
IfH = 'if' Named ':' ; IfI = 'if' Named ':' Simple ;
ElifH = 'elif' Named ':' ; ElifI = 'elif' Named ':' Simple ;
ElseH = 'else' ':' ; ElseI = 'else' ':' Simple ;
WhileX = 'while' Named ':' | 'async'? 'for' Targets 'in' Exprs ':' ;
LoopH = WhileX ; LoopI = WhileX Simple ;
TryH = 'try' ':' ; TryI = 'try' ':' Simple ;
ExceptX = 'except' '*'? (Expr ('as' NAME)? | Expr (',' Expr)+)? ':' ;
ExceptH = ExceptX ; ExceptI = ExceptX Simple ;
FinH = 'finally' ':' ; FinI = 'finally' ':' Simple ;
WithX = 'async'? 'with' (WItem (',' WItem)* | @WItems) ':' ;
WItem = Expr ('as' Target)? ;
WItems = WItem (',' WItem)* ','? ;
DefX = 'async'? 'def' NAME @TParams? @Params ('->' Exprs)? ':' | 'class' NAME @TParams? @Args? ':' | WithX ;
DefH = DefX ; DefI = DefX Simple ;
Deco = '@' Named ;
MatchH = 'match' Exprs ':' ;
CaseX = 'case' Pats ('if' Named)? ':' ;
CaseH = CaseX ; CaseI = CaseX Simple ;
Pats = Pat (',' Pat)* ','? ;
Pat = '*' NAME | OrPat ('as' NAME)? ;
OrPat = CPat ('|' CPat)* ;
CPat = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted @PArgs? | @PSeq | @PMap ;
PSeq = Pats? ;
PArgs = (PArg (',' PArg)* ','?)? ;
PArg = NAME '=' Pat | Pat ;
PMap = (PPair (',' PPair)* ','?)? ;
PPair = '**' NAME | ('-'? NUM | STR+ | Dotted | 'None' | 'True' | 'False') ':' Pat ;
Block = Stmt* ;
Suite = Stmt+ ;
Cases = ((@CaseH @Suite) | @CaseI)+ ;
Stmt = @Simple | (@IfH @Suite | @IfI) ((@ElifH @Suite) | @ElifI)* Else?
  | (@LoopH @Suite | @LoopI) Else? | @DefH @Suite | @DefI | @Deco+ (@DefH @Suite | @DefI)
  | (@TryH @Suite | @TryI) ((@ExceptH @Suite | @ExceptI)+ Else? Finally? | Finally) | @MatchH @Cases ;
Else = @ElseH @Suite | @ElseI ;
Finally = @FinH @Suite | @FinI ;
"""
PYTHON_CLASSES = {
    "NAME": ["match", "case", "type"],
    "NUM": [],
    "STR": [],
    "BINOP": ["and", "or", "!=", "<=", ">=", "//", "%", "&", "^", "<<", ">>"],
    "AUGOP": ["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="],
}

# One text for script and module; the lines marked T hold the typed dialect's additions.
_SCRIPT = r"""
Script = (Stmt)* ;
Module = (Stmt | Import | Export)* ;
Block = Stmt* ;
Semi = ';' | ASI ;
Stmt = @Block | ';' | VarDecl Semi | Func | Class | 'if' @Paren Stmt ('else' Stmt)? | 'for' 'await'? @ForHead Stmt
  | 'while' @Paren Stmt | 'do' Stmt 'while' @Paren ';'? | ('break' | 'continue') NAME? Semi | 'return' Expr? Semi
  | 'throw' Expr Semi | 'try' @Block ('catch' @CatchP? @Block ('finally' @Block)? | 'finally' @Block)
  | 'switch' @Paren @Switch | 'with' @Paren Stmt | 'debugger' Semi | NAME ':' Stmt | Expr Semi T(| TStmt) ;
VarDecl = ('var' | 'const' | 'let' | 'using') Binding (',' Binding)* ;
Binding = Target T('!'?) T((':' Type)?) ('=' Assign)? ;
Target = NAME | @Obj | @Arr ;
Func = 'async'? 'function' '*'? NAME? T(TParams?) @Params T(RetAnn?) (@Block T(| Semi)) ;
Class = Deco* T('abstract'?) 'class' (NAME)? T(TParams?) ('extends' Lhs T(TArgs?))? T(('implements' Types)?) @ClassBody ;
Deco = '@' (NAME ('.' IDN)* @Args? | @Paren) ;
ClassBody = (Member | ';')* ;
Member = Deco* Mod* MName T(('?' | '!')?) (T(TParams?) @Params T(RetAnn?) (@Block T(| Semi)) | T((':' Type)?) ('=' Assign)? Semi)
  | 'static' @Block T(| Mod* @IndexSig ':' Type Semi) ;
Mod = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' T(| TMOD) ;
MName = IDN | STR | NUM | PRIV | @Computed ;
Computed = Assign ;
Switch = ('case' Expr ':' Stmt* | 'default' ':' Stmt*)* ;
CatchP = Target T((':' Type)?) ;
ForHead = (VarDecl | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const' | 'using')? (Target | Lhs) ('of' | 'in') Expr ;
Paren = Expr ;
Args = (Spread (',' Spread)* ','?)? ;
Spread = '...'? Assign ;
Spreading = '...' Assign ;
Hole = Spread? ;
Arr = ','* ('...'? Assign (','+ '...'? Assign)* ','*)? ;
Index = Expr ;
Obj = (Prop (',' Prop)* ','?)? ;
Prop = '...' Assign | (IDN | STR | NUM | @Computed) ':' Assign | NAME ('=' Assign)?
  | ('async' | 'get' | 'set' | '*')* MName T(TParams?) @Params T(RetAnn?) @Block ;
Params = (Param (',' Param)* ','?)? ;
Param = Deco* T(TMOD*) '...'? Target2 T('?'?) T((':' Type)?) ('=' Assign)? ;
Target2 = Target T(| 'this') ;
Expr = Assign (',' Assign)* ;
Assign = 'async'? (NAME | T(TParams?) @Params T(RetAnn?)) '=>' (Assign | @Block) | 'yield' '*'? Assign? | Cond (AssignOp Assign)? ;
AssignOp = '=' | ASSIGNOP | '>' '>'? '>=' ;
Cond = Bin ('?' Assign ':' Assign)? ;
Bin = Unary (BinOp Unary)* ;
BinOp = BINOP | '-' | '+' | '*' | '<' | '>' ('>' '>'?)? | '>=' | 'in' | '|' | '&' ;
Unary = (UNOP | '+' | '-' T(| '<' Type '>'))* Lhs ('++' | '--')? T(('as' Type | 'satisfies' Type)*) ;
Lhs = 'new'* Primary Trailer* ;
Primary = NAME | NUM | STR | TEMPLATE | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | @Arr | @Obj | @Paren | Func | Class
  | 'new' '.' NAME | 'import' ('.' NAME | @Args) | PRIV ;
Trailer = '.' (IDN | PRIV) | '?.' (IDN | PRIV | @Args | @Index) | @Index | @Args | TEMPLATE T(| '!' | TArgs) ;
Import = 'import' (STR | T('type'?) Clause 'from' STR) (('with' | 'assert') @Obj)? Semi T(| 'import' T('type'?) NAME '=' Expr Semi) ;
Clause = NAME (',' (@Names | '*' 'as' NAME))? | @Names | '*' 'as' NAME ;
Names = (NameAs (',' NameAs)* ','?)? ;
NameAs = T('type'?) (IDN | STR) ('as' (IDN | STR))? ;
Export = 'export' ('*' ('as' (IDN | STR))? 'from' STR Semi | T('type'?) @Names ('from' STR)? Semi
  | 'default' (Func | Class | Assign Semi T(| TStmt)) | VarDecl Semi | Func | Class T(| TStmt | '=' Expr Semi | 'as' 'namespace' NAME Semi)) | Deco+ 'export' 'default'? Class ;
"""
_TYPES = r"""
RetAnn = ':' RetType ;
RetType = 'asserts' (NAME | 'this') ('is' Type)? | (NAME | 'this') 'is' Type | Type ;
Type = UType ('extends' Type '?' Type ':' Type)? | 'abstract'? 'new'? TParams? @Params '=>' RetType ;
UType = ('|' | '&')? PType (('|' | '&') PType)* ;
PType = ('keyof' | 'unique' | 'readonly' | 'infer')* AType @TIndex* ;
AType = Qual TArgs? | STR | '-'? NUM | TEMPLATE | 'null' | 'void' | 'this' | 'true' | 'false' | 'typeof' (Qual | 'this' | 'import' @Args) TArgs?
  | @TypeLit | @Tuple | @PParen | 'import' @Args ('.' IDN)* TArgs? ;
PParen = Type ;
Qual = NAME ('.' IDN)* ;
TIndex = Type? ;
Tuple = (TElem (',' TElem)* ','?)? ;
TElem = '...'? (NAME '?'? ':' Type | Type '?'?) ;
TArgs = '<' Types ','? '>' ;
Types = Type (',' Type)* ;
TParams = '<' TParam (',' TParam)* ','? '>' ;
TParam = ('in' | 'out' | 'const')* NAME ('extends' Type)? ('=' Type)? ;
IndexSig = NAME ':' Type | NAME 'in' Type ('as' Type)? ;
TypeLit = (TMember (';' | ',' | ASI))* ;
TMember = ('readonly' | '-' 'readonly' | '+' 'readonly' | 'get' | 'set')* (MName '?'? (TParams? @Params RetAnn? | (':' Type)?)
  | 'new'? TParams? @Params RetAnn? | @IndexSig ('-'? '?')? (':' Type)?) ;
Enum = (EItem (',' EItem)* ','?)? ;
EItem = (IDN | STR | @Computed) ('=' Assign)? ;
TStmt = 'interface' NAME TParams? ('extends' Types)? @TypeLit | 'type' NAME TParams? '=' Type Semi | 'const'? 'enum' NAME @Enum
  | 'declare' (VarDecl Semi | Func | Class | TStmt | 'global' @Module) | ('namespace' | 'module') (Qual | STR) (@Module | Semi) ;
"""
_WORDS = "async await of get set static as from let yield accessor using".split()
_TWORDS = (
    "abstract asserts declare enum global implements infer interface is keyof module namespace out override private protected public readonly satisfies type unique"
).split()
_RESERVED = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new "
    "null return super switch this throw true false try typeof var void while with assert"
).split()
_JS_CLASSES = {
    "NAME": [*_WORDS, *[w for w in _TWORDS if w != "enum"], "assert"],
    "IDN": ["NAME", *_WORDS, *_TWORDS, *_RESERVED],
    "TMOD": ["public", "private", "protected", "readonly", "abstract", "override", "declare"],
    "NUM": [],
    "STR": [],
    "TEMPLATE": [],
    "REGEX": [],
    "PRIV": [],
    "UNOP": ["!", "~", "typeof", "void", "delete", "await", "++", "--"],
    "BINOP": ["/", "%", "**", "<<", "<=", "==", "!=", "===", "!==", "^", "&&", "||", "??", "instanceof"],
    "ASSIGNOP": ["+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="],
}


def _dialect(typed: bool) -> str:
    """The script text with or without what stands in T(...)."""
    out, i, text = [], 0, _SCRIPT
    while (j := text.find("T(", i)) >= 0:
        if text[j - 1].isalnum():
            out.append(text[i : j + 2])
            i = j + 2
            continue
        depth, k, quoted = 1, j + 2, False
        while depth:
            quoted ^= text[k] == "'"
            depth += 0 if quoted else (text[k] == "(") - (text[k] == ")")
            k += 1
        inner = text[j + 2 : k - 1]
        if typed:
            text = text[:j] + inner + text[k:]
        else:
            text = text[:j] + text[k:]
        out.append(text[i:j])
        i = j
    out.append(text[i:])
    return "".join(out) + (_TYPES if typed else "")


JAVASCRIPT, TYPESCRIPT = _dialect(False), _dialect(True)
TSX = TYPESCRIPT.replace("'-' | '<' Type '>'", "'-'")

JAVA = r"""
File = (Top | ';')* ;
Top = Annot* 'package' Qual ';' | 'import' ('static' | 'module')? Qual ('.' '*')? ';' | TypeDecl
  | ('open'? 'module' Qual @ModBody) | Member ;
ModBody = (('requires' | 'exports' | 'opens' | 'uses' | 'provides') ('transitive' | 'static')* Qual (('to' | 'with') Qual (',' Qual)*)? ';')* ;
Qual = NAME ('.' NAME)* ;
Mod = Annot | MOD | 'non' '-' 'sealed' ;
Annot = '@' Qual @AnnArgs? ;
AnnArgs = (AnnArg (',' AnnArg)* ','?)? ;
AnnArg = (NAME '=')? ElemVal ;
ElemVal = Annot | @ElemVals | Cond ;
ElemVals = (ElemVal (',' ElemVal)* ','?)? ;
TypeDecl = Mod* ('class' NAME TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? @ClassBody
  | 'interface' NAME TParams? ('extends' Types)? ('permits' Types)? @ClassBody
  | 'enum' NAME ('implements' Types)? @EnumBody | 'record' NAME TParams? @Params ('implements' Types)? @ClassBody | '@' 'interface' NAME @ClassBody) ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Annot* NAME ('extends' Type ('&' Type)*)? ;
Types = Type (',' Type)* ;
Type = Annot* (PRIM | NAME TArgs? ('.' Annot* NAME TArgs?)*) (Annot* @Empty)* ;
TArgs = '<' (TArg (',' TArg)*)? '>' ;
TArg = Annot* '?' (('extends' | 'super') Type)? | Type ;
Empty = ;
ClassBody = (Member | ';')* ;
EnumBody = (EnumConst (',' EnumConst)* ','?)? (';' (Member | ';')*)? ;
EnumConst = Annot* NAME @Args? @ClassBody? ;
Member = TypeDecl | 'static'? @Block | Mod* TParams? (Type | 'void') NAME @Params @Empty* Throws? (@Block | ('default' ElemVal)? ';')
  | Mod* TParams? NAME @Params Throws? @Block | Mod* NAME @Block | Mod* Type VarDecls ';' ;
Throws = 'throws' Types ;
Params = (Param (',' Param)*)? ;
Param = Mod* Type (Annot* '...')? (NAME @Empty* | (NAME '.')? 'this') ;
VarDecls = VarDecl (',' VarDecl)* ;
VarDecl = NAME @Empty* ('=' (@ArrInit | Expr))? ;
ArrInit = (ArrItem (',' ArrItem)* ','?)? ;
ArrItem = Expr | @ArrInit ;
Block = Stmt* ;
Local = Mod* Type VarDecls ;
Stmt = @Block | ';' | Local ';' | TypeDecl | 'if' @Paren Stmt ('else' Stmt)? | 'while' @Paren Stmt | 'do' Stmt 'while' @Paren ';'
  | 'for' @ForHead Stmt | 'switch' @Paren @Switch | 'try' (@Res @Block Catch* Fin? | @Block (Catch+ Fin? | Fin))
  | 'synchronized' @Paren @Block | 'return' Expr? ';' | 'throw' Expr ';' | ('break' | 'continue') NAME? ';' | 'yield' Expr ';'
  | 'assert' Expr (':' Expr)? ';' | NAME ':' Stmt | ExprStmt ';' ;
ExprStmt = Cond (AssignOp Expr)? ;
Catch = 'catch' @CatchP @Block ;
Fin = 'finally' @Block ;
CatchP = Mod* Type ('|' Type)* NAME ;
Res = ResItem (';' ResItem)* ';'? ;
ResItem = Local | Cond ;
ForHead = (Local | ExprStmt (',' ExprStmt)*)? ';' Expr? ';' (ExprStmt (',' ExprStmt)*)? | Mod* Type NAME @Empty* ':' Expr ;
Switch = ((Label ':')+ Stmt* | Label '->' (Expr ';' | @Block | 'throw' Expr ';'))* ;
Label = 'case' CaseItem (',' CaseItem)* ('when' Cond)? | 'default' ;
CaseItem = Cond | 'default' | Pattern ;
Pattern = Mod* Type (NAME | @Patterns NAME?) ;
Patterns = (Pattern (',' Pattern)*)? ;
Paren = Expr ;
Args = (Expr (',' Expr)*)? ;
Index = Expr ;
LParams = ((NAME (',' NAME)*) | Param (',' Param)*)? ;
Expr = (NAME | @LParams) '->' (Expr | @Block) | Cond (AssignOp Expr)? ;
AssignOp = '=' | ASSIGNOP | '>' '>'? '>=' ;
Cond = Bin ('?' Expr ':' Expr)? ;
Bin = Un (BinOp Un | 'instanceof' (Mod* Type | Pattern))* ;
BinOp = BINOP | '-' | '+' | '*' | '<' | '>' ('>' '>'?)? | '>=' | '&' | '|' ;
Un = ('+' | '-' | UNOP | @CastType)* Prim Trail* ('++' | '--')? | ('+' | '-' | UNOP)* @CastType (NAME | @LParams) '->' (Expr | @Block) ;
CastType = Type ('&' Type)* ;
Prim = NAME | LIT | 'this' | 'super' | @Paren | 'new' Annot* TArgs? CType (@Args @ClassBody? | (Annot* @Index)+ @Empty* | @Empty+ @ArrInit)
  | 'switch' @Paren @Switch | (PRIM | 'void') @Empty* '.' 'class' | NAME ('.' NAME)* @Empty+ '.' 'class' | Type '::' TArgs? (NAME | 'new') ;
CType = PRIM | NAME TArgs? ('.' Annot* NAME TArgs?)* ;
Trail = '.' (TArgs? NAME | TArgs? 'super' | 'class' | 'this' | 'new' Annot* CType @Args @ClassBody?) | @Args | @Index | '::' TArgs? (NAME | 'new') ;
"""
JAVA_CLASSES = {
    "NAME": "record sealed permits non when yield module open requires exports opens uses provides to with transitive var".split(),
    "PRIM": "int long short byte char boolean float double".split(),
    "MOD": "public private protected static final abstract native synchronized transient volatile strictfp default sealed".split(),
    "LIT": ["NUM", "STR", "CHAR", "true", "false", "null"],
    "NUM": [],
    "STR": [],
    "CHAR": [],
    "UNOP": ["!", "~", "++", "--"],
    "BINOP": ["/", "%", "<<", "<=", "==", "!=", "^", "&&", "||"],
    "ASSIGNOP": ["+=", "-=", "*=", "/=", "%=", "<<=", "&=", "|=", "^="],
}

GO = r"""
File = 'package' NAME (';' Top?)* ;
Tops = (Top? ';')* Top? ;
Head = 'package' NAME ;
Top = 'import' (Spec | @Specs) | Decl | Func ;
Spec = (NAME | '.')? STR ;
Specs = (Spec? ';')* Spec? ;
Func = 'func' @Params? NAME @TParams? Sig @Block? ;
Decl = ('var' | 'const') (VSpec | @VSpecs) | 'type' (TSpec | @TSpecs) ;
VSpec = NAME (',' NAME)* Type? ('=' Exprs)? ;
VSpecs = (VSpec? ';')* VSpec? ;
TSpec = NAME @TParams? '='? Type ;
TSpecs = (TSpec? ';')* TSpec? ;
TParams = NAME (',' NAME)* Constr (',' NAME (',' NAME)* Constr)* ','? ;
Constr = '~'? Type ('|' '~'? Type)* ;
Sig = @Params (Type | @Params)? ;
Params = (Param (',' Param)* ','?)? ;
Param = (NAME? '...'? Type) ;
Type = NAME ('.' NAME)? @TArgs? | '*' Type | @Len Type | 'map' @Len Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig
  | 'struct' @Fields | 'interface' @Iface | @PType ;
PType = Type ;
Len = (Type | Expr | '...')? ;
TArgs = Type (',' Type)* ','? ;
Fields = (Field? ';')* Field? ;
Field = (NAME (',' NAME)* Type | '*'? NAME ('.' NAME)? @TArgs?) STR? ;
Iface = (IElem? ';')* IElem? ;
IElem = NAME Sig | Constr ;
Block = (Stmt? ';')* Stmt? ;
Stmt = Decl | Simple | 'return' Exprs? | ('break' | 'continue') NAME? | 'goto' NAME | 'fallthrough' | 'go' Expr | 'defer' Expr
  | @Block | If | 'for' ForHead? @Block | 'switch' (Simple? ';')? Simple? @Switch | 'select' @Switch | NAME ':' Stmt? ;
If = 'if' (Simple? ';')? Expr @Block ('else' (If | @Block))? ;
ForHead = Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr ;
Simple = Exprs (('=' | ':=' | ASSIGNOP) Exprs | '++' | '--' | '<-' Expr)? ;
Switch = (('case' Cases | 'default') ':' Block)* ;
Cases = Case (',' Case)* ','? | Simple ;
Case = Expr | Type ;
Exprs = Expr (',' Expr)* ;
Expr = Un (BinOp Un)* ;
BinOp = BINOP | '*' | '-' | '+' | '&' | '^' | '|' | '<-' ;
Un = ('*' | '-' | '+' | '&' | '^' | '!' | '<-')* Prim Trail* ;
Prim = NAME | LIT | @Paren | 'func' Sig @Block | TLit ;
TLit = @Len Type | 'map' @Len Type | 'struct' @Fields | 'interface' @Iface | 'chan' Type | '<-' 'chan' Type ;
Paren = Expr | Type ;
Trail = '.' NAME | '.' @Assert | @Index | @Args | @Lit ;
Assert = 'type' | Type ;
Index = Expr? ':' Expr? (':' Expr)? | (Expr | Type) (',' (Expr | Type))* ','? ;
Args = (Arg (',' Arg)* '...'? ','?)? ;
Arg = Expr | Type ;
Lit = (LElem (',' LElem)* ','?)? ;
LElem = (LVal ':')? LVal ;
LVal = Expr | @Lit ;
"""
GO_CLASSES = {
    "NAME": [],
    "NUM": [],
    "STR": [],
    "CHAR": [],
    "LIT": ["NUM", "STR", "CHAR"],
    "BINOP": ["/", "%", "<<", ">>", "&^", "==", "!=", "<", "<=", ">", ">=", "&&", "||"],
    "ASSIGNOP": ["+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^=", "&^="],
}

JSON = r"""
File = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | @Object | @Array ;
Object = (Pair (',' Pair)*)? ;
Pair = STR ':' Value ;
Array = (Value (',' Value)*)? ;
"""
JSON_CLASSES = {"STR": [], "NUM": []}
